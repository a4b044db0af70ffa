"""Spark-native analytics for multi-frequency echosounder surveys."""
