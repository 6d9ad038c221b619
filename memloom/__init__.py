"""Memory analytics on Spark: scoped retrieval, claim processing and data cleaning as DataFrame plans."""

__version__ = "0.1.0"
