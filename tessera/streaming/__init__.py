"""Streams: the query language has none (a table is one immutable file), so nothing is defined here."""
