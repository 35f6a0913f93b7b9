"""Spark-native analytics over evacuation studies: telemetry tables, operators, sources."""
