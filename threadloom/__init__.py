"""Spark-native string similarity joins, density clustering and consensus."""

__version__ = "0.1.0"
