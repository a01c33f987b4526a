"""operators of evalspark."""
