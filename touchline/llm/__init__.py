"""Operators for preparing training text: secrets, duplicates, quality, language, tokens, packing, neighbours.

Nothing else in the library imports this subpackage.
"""
