"""Spark-native data integration: declarative pipelines of sources, map nodes and sinks over DataFrames."""
