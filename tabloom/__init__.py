"""Spark-native, control-file-driven analytics."""
