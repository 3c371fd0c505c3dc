"""Sensitive-data discovery and pseudonymization over text tables and source trees, on Spark DataFrames."""
