"""A PySpark-native analytics engine for frame-level behavioural time series."""
