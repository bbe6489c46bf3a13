"""Operators on tables of facts, ranges and texts."""
