"""logloom: a PySpark-native engine for log ingestion, search and large-scale log data processing."""

__version__ = "0.1.0"
