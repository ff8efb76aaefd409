"""A PySpark-native analytics engine for road networks, geocoding and dispatch."""
