"""A PySpark-native engine for log analytics and training-data pipelines."""
