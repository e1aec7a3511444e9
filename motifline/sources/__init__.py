"""Readers, writers and generated series."""
