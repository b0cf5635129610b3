"""Spark-first engine for auditing partition ensembles and the tables behind them."""

__version__ = "0.1.0"
