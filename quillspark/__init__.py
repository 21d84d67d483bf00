"""Spark-native document ETL, retrieval, validation and training-data operators."""
