"""Spark-native analytics engine for rule-based strategies on price bars."""
