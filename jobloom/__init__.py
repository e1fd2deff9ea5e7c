"""jobloom: job-market data processing on Spark DataFrames."""
