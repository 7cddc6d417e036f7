"""Spark-native notice monitoring engine; training-data operators live in ``tidewatch.llm``."""
