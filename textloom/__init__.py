"""Text and web-corpus analytics on Spark DataFrames."""
