"""Columns: distances and text forms."""
