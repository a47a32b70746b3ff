"""leafmill: paged documents to a searchable passage store, on PySpark."""
