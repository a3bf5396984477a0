"""quiverlake: exact and approximate vector search, and data preparation, expressed as Spark plans."""
