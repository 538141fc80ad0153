"""Spark-native road and building graph analytics."""
