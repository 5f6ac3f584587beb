"""Lexical and text analytics on Spark DataFrames."""
