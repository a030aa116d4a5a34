"""Spark-native commerce evidence and economics engine."""
