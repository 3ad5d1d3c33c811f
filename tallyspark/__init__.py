"""Spark-native analytics over ordered per-entity logs."""
