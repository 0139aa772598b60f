"""Operators from glyphs on pages to checked tables."""
