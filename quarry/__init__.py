"""quarry: document search and search analytics on Spark DataFrames."""
