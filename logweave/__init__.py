"""Log template mining and log analytics on Spark DataFrames."""
