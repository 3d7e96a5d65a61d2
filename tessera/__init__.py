"""Document indexing, search and bounded SQL as Spark DataFrame plans."""
