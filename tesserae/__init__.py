"""A Spark-native engine for content-addressed text, run-length sequences, exact coordinates and evidence."""
