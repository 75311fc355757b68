"""Operators for the making of training text. Nothing else in the library imports this package."""
