"""Sequence-overlap analytics and corpus operators on Spark DataFrames."""
