"""A PySpark-native engine for mining review-style data at scale."""

__version__ = "0.1.0"
