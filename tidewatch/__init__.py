"""Network-threat analytics on Spark DataFrames; see README.md."""
