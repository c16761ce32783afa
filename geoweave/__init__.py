"""geoweave: Spark-native analytics over geographic vector layers and their graphs."""
