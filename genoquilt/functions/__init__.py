"""Association scans on Spark DataFrames."""
