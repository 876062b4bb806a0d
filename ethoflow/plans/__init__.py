"""Whole queries over the standard tables."""
