"""Top-N recommendation from interaction logs, as Spark DataFrame jobs."""

__version__ = "0.1.0"
