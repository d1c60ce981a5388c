"""Spark-native engine for auditing, cleaning, splitting and scoring labelled document datasets."""

__version__ = "0.1.0"
