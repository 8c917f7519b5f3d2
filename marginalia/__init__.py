"""A PySpark-native engine for document text analytics, retrieval and evaluation."""
