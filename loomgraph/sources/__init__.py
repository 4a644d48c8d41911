"""Readers, writers and generated graphs."""
