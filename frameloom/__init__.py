"""Speech, array-signal and graph analytics on Spark DataFrames."""
