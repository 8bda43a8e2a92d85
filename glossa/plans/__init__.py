"""Part of the corpus engine: plans."""
