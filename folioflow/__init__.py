"""Document structuring, translation planning and publishing over Spark DataFrames."""
