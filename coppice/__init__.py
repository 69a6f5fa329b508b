"""Spark-native regression tree ensembles and the data plumbing around them."""
