"""A Spark-first engine for code-knowledge analytics and training-data preparation."""

__version__ = "0.1.0"
