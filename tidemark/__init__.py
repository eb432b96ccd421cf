"""tidemark: a Spark-first log-evidence analytics engine."""

__version__ = "0.1.0"
