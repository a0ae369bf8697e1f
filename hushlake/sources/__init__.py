"""Sources of the sensitive-text engine."""
