"""Relational, sequence and statistical operators over frame tables."""
