"""Tideline: Spark-first analytics over timestamped message streams."""

__version__ = "0.1.0"
