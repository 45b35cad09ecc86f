"""Scalar functions, filters and folds."""
