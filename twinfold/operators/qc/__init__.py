"""Literal checks between a source text and its draft translation."""
