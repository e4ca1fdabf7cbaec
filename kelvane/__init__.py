"""A PySpark-native engine for consolidating, enriching and analysing entity data."""
