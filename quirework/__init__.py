"""Corpus analytics on Spark: relational, ordered, vector and audit operators over a passage store."""
