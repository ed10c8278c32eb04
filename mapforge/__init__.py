"""Semantic table mapping and corpus preparation on Spark DataFrames."""
