"""A PySpark-native engine for messages, documents and training text."""
