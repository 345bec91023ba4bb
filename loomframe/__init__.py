"""PySpark-native engine for media-packet analytics, measurement reports and licensing tables."""
