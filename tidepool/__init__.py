"""A Spark-native memory and hybrid-retrieval engine."""
