"""claimloom: a Spark-native analytics engine for dated, directed claim graphs."""

__version__ = "0.1.0"
