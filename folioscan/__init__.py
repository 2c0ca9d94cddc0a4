"""Full-text document search, incremental indexing and corpus work as Spark DataFrame plans."""

__version__ = "0.1.0"
