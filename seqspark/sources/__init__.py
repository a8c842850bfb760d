"""Readers, writers and the normalised tables."""
