"""Pick-contest analytics on Spark: every function takes and returns DataFrames."""
