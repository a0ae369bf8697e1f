"""hushlake: sensitive-text analytics expressed as Spark DataFrame plans."""
