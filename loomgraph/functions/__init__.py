"""Column and table helpers."""
