"""Operators for preparing training text and model inputs; nothing outside imports this package."""
