"""Column functions. Every one is built from native expressions."""
