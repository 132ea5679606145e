"""Operators on training texts; nothing else in the package imports this."""
