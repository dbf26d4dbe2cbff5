"""Spark-native analytics over text, graphs, change histories and event logs."""
