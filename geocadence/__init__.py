"""Geospatial time-series analytics as Spark DataFrame plans."""
