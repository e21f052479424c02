"""Spark-native grounding analytics: lexical index, resolution, graph and evaluation operators."""
