"""Analytics for second-hand marketplaces as plain PySpark DataFrame operators."""

__version__ = "0.1.0"
