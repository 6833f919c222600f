"""Spark-first engine for building and scoring ontologies and knowledge graphs."""

__version__ = "0.1.0"
