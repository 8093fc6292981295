"""loglathe: a PySpark-native engine for structured event and access logs."""

__version__ = "0.1.0"
