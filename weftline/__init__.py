"""A PySpark-native analytics engine for software-evolution data."""
