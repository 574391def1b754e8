"""Batch and streaming data jobs over tables, written with Spark DataFrames."""
