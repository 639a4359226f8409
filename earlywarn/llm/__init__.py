"""Operators for preparing text corpora at scale: scoring, filtering, linking, mixing and archiving."""
