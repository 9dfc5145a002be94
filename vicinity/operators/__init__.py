"""Relational operators on points and graphs."""
