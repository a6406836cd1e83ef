"""Signal, statistics and graph operators on DataFrames."""
