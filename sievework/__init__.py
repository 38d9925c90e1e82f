"""Evidence-based opportunity analytics on Spark DataFrames."""
