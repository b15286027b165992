"""Spark-native supply-network analytics."""
