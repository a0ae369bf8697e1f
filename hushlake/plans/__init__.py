"""Plans of the sensitive-text engine."""
