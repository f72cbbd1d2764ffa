"""Algebra, paths, aggregates, updates, validation and graph analytics over quads."""
