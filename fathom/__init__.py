"""Fathom: hybrid retrieval, note graphs and retrieval evaluation as Spark DataFrame plans."""

__version__ = "0.1.0"
