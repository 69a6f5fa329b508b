"""Functions of the tree engine."""
