"""A Spark-native analytics engine for program facts, reports, graphs and event streams."""
