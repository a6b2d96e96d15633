"""Document-to-knowledge-base analytics on PySpark DataFrames."""
