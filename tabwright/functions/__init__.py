"""Column-level functions: formulas and text expressions."""
