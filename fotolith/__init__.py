"""fotolith: a Spark-native analytics engine for large photograph catalogs."""
