"""Spark-native engine for register records: ingest, extraction, linkage, graph and analytics."""
