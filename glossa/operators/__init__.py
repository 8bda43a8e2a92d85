"""Part of the corpus engine: operators."""
