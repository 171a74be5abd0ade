"""sourceweave: Spark-native analytics for news corroboration."""
