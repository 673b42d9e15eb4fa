"""Operators of a training-data pipeline: corpus preparation over tables of documents, pages and vectors."""
