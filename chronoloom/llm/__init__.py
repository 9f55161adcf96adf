"""Operators on training text and model records; nothing else in the library imports this subpackage."""
