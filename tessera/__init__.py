"""Keyword-deck, laminate and mesh analytics on Spark DataFrames."""
