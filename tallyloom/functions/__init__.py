"""Column functions: text normal forms, markup, labels, scoring, HTML review."""
