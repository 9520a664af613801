"""Organization-name linking on Spark DataFrames."""
