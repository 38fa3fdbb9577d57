"""Song-library analytics expressed as PySpark DataFrame, SQL and Structured Streaming plans."""

__version__ = "0.1.0"
