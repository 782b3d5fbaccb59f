"""Lodestone: full-text indexing, ranked retrieval and corpus analytics on PySpark."""
