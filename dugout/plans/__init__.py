"""Derived tables, named queries and studies."""
