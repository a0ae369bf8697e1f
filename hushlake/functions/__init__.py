"""Functions of the sensitive-text engine."""
