"""Relational operators, each a composition of DataFrame operations."""
