"""Operators on survey tables."""
