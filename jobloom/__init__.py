"""Job-market analytics on Spark DataFrames."""
