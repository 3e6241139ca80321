"""Spark-native analytics over graphs, ragged sets, molecules, proteins and text."""
