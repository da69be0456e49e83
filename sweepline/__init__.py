"""Sensor-recording analytics and corpus operators on PySpark."""
