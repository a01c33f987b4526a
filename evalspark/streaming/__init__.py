"""streaming of evalspark."""
