"""Spark-native analytics over event streams: one logical API, batch and streaming."""
