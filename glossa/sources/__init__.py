"""Part of the corpus engine: sources."""
