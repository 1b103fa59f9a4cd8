"""Lexwright: versioned legal-text analytics on Spark DataFrames."""
