"""Spark-native analytics over authentication-style event logs."""
