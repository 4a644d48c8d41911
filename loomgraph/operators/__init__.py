"""Operators on node, edge, prediction and measurement tables."""
