"""Sources of the tree engine."""
