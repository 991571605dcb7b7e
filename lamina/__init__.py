"""Label-filtered vector search and training-data operators on Spark DataFrames."""
