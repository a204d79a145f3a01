"""corpusflow: retrieval-oriented text processing on Spark DataFrames."""
