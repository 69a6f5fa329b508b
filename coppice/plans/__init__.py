"""Plans of the tree engine."""
