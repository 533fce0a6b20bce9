"""foliant: ranking and curating a document corpus with Spark DataFrames."""
