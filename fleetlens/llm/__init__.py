"""Operators for the preparation of training text: ten operators over documents, pages and vectors.

Nothing else in the library imports this subpackage.
"""
