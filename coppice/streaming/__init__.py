"""Streaming of the tree engine."""
