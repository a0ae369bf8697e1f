"""Streaming of the sensitive-text engine."""
