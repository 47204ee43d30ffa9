"""Spark-native analytics over array-valued data: ingestion, quantization, entropy coding, reports."""
