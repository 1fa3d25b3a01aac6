"""Spark-native search, citation checking and measurement over document collections."""
