"""A PySpark-native engine for positional signal profiles over annotated intervals."""
