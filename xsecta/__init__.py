"""Spark-native cross-sectional research and backtesting engine."""
