"""Readers, writers and the skip-if-done guard."""
