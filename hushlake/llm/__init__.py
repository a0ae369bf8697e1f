"""Training-data operators. Nothing else in hushlake imports this package."""
