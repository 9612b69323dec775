"""Readers, writers and sample data."""
