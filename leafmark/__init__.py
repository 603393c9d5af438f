"""leafmark: a PySpark-native engine for document records."""
