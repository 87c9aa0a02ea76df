"""Spark-native evidence fusion: belief masses, graph retrieval, metrics and statistics on DataFrames."""
