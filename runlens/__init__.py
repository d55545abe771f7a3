"""Spark-native analytics over agent-run telemetry and training corpora."""
