"""Readers and the clinical views of the event tables."""
