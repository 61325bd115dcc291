"""Sensor-evidence analytics as DataFrame and Structured Streaming operators."""
