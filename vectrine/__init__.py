"""Vectrine: semantic retrieval and retrieval-augmented analytics on Spark DataFrames."""

__version__ = "0.1.0"
