"""Collaborative quantile forecasting on Spark: combine, score, rank, report."""

__version__ = "0.1.0"
