"""docmill: document collections to searchable tables, as Spark DataFrame jobs."""

__version__ = "0.1.0"
