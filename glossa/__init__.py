"""A Spark-native engine that builds, rewrites and measures text corpora."""
