"""Spark-native observability analytics: DataFrame-to-DataFrame operators, plans, sources and streams."""
