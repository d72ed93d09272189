"""weirflow: Spark-native flow analytics and request metrics."""
