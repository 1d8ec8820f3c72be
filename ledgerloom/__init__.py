"""ledgerloom: Spark-native analytics over report portfolios and their training data."""

__version__ = "0.1.0"
