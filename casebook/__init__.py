"""A Spark-native engine that links collections of short texts into evidence-scored incidents."""
