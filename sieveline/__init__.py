"""sieveline: a Spark-first text-moderation and dataset-building engine."""

__version__ = "0.1.0"
