"""Tidemark: versioned key-value analytics on Spark."""
