"""Column functions (built-ins only)."""
