"""functions of evalspark."""
