"""Streams over the operation log."""
