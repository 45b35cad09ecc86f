"""Relational operators over a log of versions."""
