"""Operators on feature, scene and request tables."""
