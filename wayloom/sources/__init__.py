"""Readers, writers and the derived example tables."""
