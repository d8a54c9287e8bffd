"""Hourly road-sensor analytics as Spark DataFrame jobs."""
