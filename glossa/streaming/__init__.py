"""Part of the corpus engine: streaming."""
