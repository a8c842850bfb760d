"""Operators from normalised tables to features, scores, metrics and decisions."""
