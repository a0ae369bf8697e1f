"""Operators of the sensitive-text engine."""
