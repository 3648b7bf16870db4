"""Spark-native analytics for labelled time series."""
