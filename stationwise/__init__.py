"""Spark-native quality, statistics and alert-modelling engine for station time series."""
