"""Loamstone: a PySpark-native analytics engine for long-term memory and retrieval workloads."""
