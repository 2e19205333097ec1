"""Marketplace analytics on Spark: canonical tables in, analytic DataFrames out."""
