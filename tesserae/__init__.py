"""A Spark-native engine for mergeable sketches of spatiotemporal observations."""
