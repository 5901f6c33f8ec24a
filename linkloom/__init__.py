"""Analytics over collections of linked documents, written as Spark jobs."""

__version__ = "0.1.0"
