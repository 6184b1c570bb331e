"""Distributed hyper-parameter search and trial-log analytics on Spark DataFrames."""
