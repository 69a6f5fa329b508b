"""Operators of the tree engine."""
