"""tidemark: market time-series analytics as PySpark DataFrame, SQL and Structured Streaming operators."""
