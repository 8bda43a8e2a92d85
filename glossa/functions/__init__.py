"""Part of the corpus engine: functions."""
