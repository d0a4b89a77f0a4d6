"""Tramline: a PySpark-native engine for urban-mobility analytics."""
