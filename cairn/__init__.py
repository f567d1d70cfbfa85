"""cairn: a PySpark-native analytics engine for structured place-review data."""
