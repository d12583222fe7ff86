"""Operators of a training-data pipeline over the documents, embeddings and pages tables."""
