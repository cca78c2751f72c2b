"""A retrieval and incremental-indexing engine over Spark DataFrames."""
