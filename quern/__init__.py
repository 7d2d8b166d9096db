"""quern: analytics on Spark DataFrames."""
