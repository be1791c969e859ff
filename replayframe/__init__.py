"""Spark-native analytics over ordered action logs and ordinary tables."""
