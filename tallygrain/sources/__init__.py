"""Readers, writers and the star-schema role mapping."""
