"""plans of evalspark."""
