"""vecspark: filtered vector search and its evaluation, expressed as Spark jobs."""

__version__ = "0.1.0"
