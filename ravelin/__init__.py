"""A PySpark-native analytics engine for monitoring, spatial, network and series data."""
