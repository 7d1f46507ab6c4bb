"""folioflow: scientific-document retrieval and text processing as Spark plans."""
