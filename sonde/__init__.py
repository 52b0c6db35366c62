"""Spark-native density analytics for labelled telemetry."""
