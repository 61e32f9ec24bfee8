"""Sableleaf: a Spark-native engine for JSON document collections."""
