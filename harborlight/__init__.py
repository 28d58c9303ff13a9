"""Analytics over orders, suppliers and text corpora as plain Spark jobs."""

__version__ = "0.1.0"
