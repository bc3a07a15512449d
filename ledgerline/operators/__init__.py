"""Projections of append-only observations into current tables."""
