"""A Spark-native evaluation and dataset analytics engine."""
