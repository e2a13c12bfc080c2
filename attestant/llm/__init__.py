"""Operators that make training text out of transcripts and scanned pages."""
