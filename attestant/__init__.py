"""Transcript analytics on Spark: DataFrames of pages and rows in, DataFrames of lines, turns, graphs and checks out."""
