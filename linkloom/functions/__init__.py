"""Column functions: text folding and tokens, and arithmetic on vectors in arrays."""
