"""Model fitting and evaluation plans over feature tables."""
