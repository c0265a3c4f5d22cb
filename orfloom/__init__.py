"""Genome-annotation, embedding and training-data analytics on Spark DataFrames."""
