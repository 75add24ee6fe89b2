"""strandmill: PySpark-native code-graph, duplication and drift analytics."""

__version__ = "0.1.0"
