"""Operators for cleaning, deduplicating, scoring and tokenising large text corpora."""
