"""Operators for training-data pipelines: documents, benchmark texts, labels and embeddings in, DataFrames out."""
