"""Spark-native engine for governed business data and, in ``llm``, training-data operators."""
