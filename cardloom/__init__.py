"""cardloom: documents to study cards on Spark DataFrames."""
