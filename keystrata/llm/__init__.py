"""Operators for preparing language-model training data.

Nothing else in ``keystrata`` imports this subpackage; it can be removed whole.
"""
