"""Retrieval and verification analytics over text cells, expressed as Spark plans."""
