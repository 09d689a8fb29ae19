"""Operators for preparing text, pages and vectors of a training corpus.

Nothing else in the library imports this subpackage.
"""
