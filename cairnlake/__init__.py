"""Cairnlake: a Spark-native analytics engine for captured web evidence."""

__version__ = "0.1.0"
