"""sources of evalspark."""
