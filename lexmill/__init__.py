"""lexmill: text and code search analytics on Spark DataFrames."""
