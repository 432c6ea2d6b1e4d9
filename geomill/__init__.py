"""Geospatial feature, imagery and request-log analytics on Spark DataFrames."""
