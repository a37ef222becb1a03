"""loomindex: Spark-native retrieval, graph and training-data operators over source trees."""
