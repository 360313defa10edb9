"""Statement-line categorisation on Spark DataFrames."""
