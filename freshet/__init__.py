"""Spark-native analytics for time-critical sensor forecasting."""
