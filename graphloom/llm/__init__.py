"""Operators for language-model text. Nothing else in the library imports this package."""
