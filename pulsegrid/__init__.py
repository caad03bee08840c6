"""Hierarchical rhythm analytics on Spark: ordered events in, metric levels, profiles and registrations out."""

__version__ = "0.1.0"
