"""Readers of source files, and the store of derived tables."""
