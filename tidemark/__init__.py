"""Session analytics and recommendation on Spark DataFrames."""
