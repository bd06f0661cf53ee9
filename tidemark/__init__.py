"""Engagement-event analytics as Spark DataFrame transformations."""
