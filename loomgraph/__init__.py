"""Spark-native knowledge analytics: DataFrame operators over a property-graph data model."""
