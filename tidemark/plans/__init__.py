"""Stateful plans: options, manifest and store."""
