"""Operators for preparing language-model training data, on the tables of raw text.

Nothing else in the library imports this subpackage.
"""
