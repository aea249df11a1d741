"""loomspan: a PySpark-native engine that turns text into typed knowledge graphs and measures them."""

__version__ = "0.1.0"
