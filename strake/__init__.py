"""strake: a PySpark-native cross-sectional panel analytics engine."""

__version__ = "0.1.0"
