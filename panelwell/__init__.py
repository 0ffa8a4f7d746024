"""Longitudinal cohort, look-back window and evaluation operators on Spark DataFrames."""
