"""Consistent account views over an out-of-order transfer stream, on Spark DataFrames."""
