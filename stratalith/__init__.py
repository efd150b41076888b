"""Spark-native analytics for molecules, crystals and other ragged tables."""
