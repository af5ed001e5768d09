"""larder: a PySpark-native analytics engine for recipe catalogues and user reviews."""

__version__ = "0.1.0"
