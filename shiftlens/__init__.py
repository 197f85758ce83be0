"""Schema-change analytics over many sources, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
