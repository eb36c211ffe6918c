"""Column expressions and window helpers shared by all operators."""
