"""A PySpark-native engine for querying e-mail."""
