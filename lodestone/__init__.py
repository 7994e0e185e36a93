"""Lodestone: retrieval, graph and evaluation analytics over text corpora, on Spark DataFrames."""
