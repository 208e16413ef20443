"""Spark-native analytics over program graphs, request captures and the tables around them."""
