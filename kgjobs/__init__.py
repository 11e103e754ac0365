"""Spark jobs for knowledge bases and training corpora."""
