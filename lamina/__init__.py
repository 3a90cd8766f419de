"""Layered-image analytics on Spark: layer trees, view states, pixels and tiles as tables."""
