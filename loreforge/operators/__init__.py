"""Operators over the memory tables."""
