"""Spark-native batch analytics for per-frame detections in sports recordings."""
