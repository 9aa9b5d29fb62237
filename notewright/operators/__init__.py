"""Dataset operators: each function takes and returns Spark DataFrames."""
