"""Process queries over event logs, compiled to Spark DataFrames."""
