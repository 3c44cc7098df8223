"""tidings: news and social media analytics on Spark DataFrames."""
