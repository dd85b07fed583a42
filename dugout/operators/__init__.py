"""Reusable relational operators over DataFrames and Columns."""
