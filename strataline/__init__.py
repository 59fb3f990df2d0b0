"""A Spark-native engine for typed tables, data quality and large-scale data preparation."""

__version__ = "0.1.0"
