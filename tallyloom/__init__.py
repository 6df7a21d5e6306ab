"""Query, index and review operators for issue-tracker corpora on Spark DataFrames."""
