"""Operators on file, range, integrity and run tables."""
