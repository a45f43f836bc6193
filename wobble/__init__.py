"""A PySpark-native engine for wording-robustness analytics."""
