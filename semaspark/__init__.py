"""Semantic models, model derivation, result comparison and evaluation analytics on Spark DataFrames."""
