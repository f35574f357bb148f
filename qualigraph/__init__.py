"""Qualigraph: a data-quality and entity-graph engine expressed as Spark plans."""

__version__ = "0.1.0"
