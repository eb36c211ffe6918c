"""Readers, writers and the scratch area."""
