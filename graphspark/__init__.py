"""graphspark: a PySpark-native analytics engine for knowledge-graph data."""

__version__ = "0.1.0"
