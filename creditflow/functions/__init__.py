"""Column functions: null-safe predicates, repeatable uniforms, bins and ranks."""
