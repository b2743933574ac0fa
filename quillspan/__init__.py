"""quillspan: corpus analytics on Spark DataFrames."""
