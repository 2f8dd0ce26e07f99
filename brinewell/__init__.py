"""Search and crawl analytics on Spark DataFrames."""
