"""Change streams of quads."""
