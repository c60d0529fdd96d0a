"""Analytics over messy string tables, built on Spark DataFrames."""
