"""DataFrame operators: filters, keyed DML, joins, index, splitting, references."""
