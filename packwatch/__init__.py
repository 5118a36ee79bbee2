"""Spark-native tracking of how packaged products change over time."""
