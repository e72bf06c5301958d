"""Operators on training text and training records; nothing outside this folder imports it."""
