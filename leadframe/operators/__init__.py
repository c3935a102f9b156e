"""Relational operators on company records."""
