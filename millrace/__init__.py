"""millrace: declarative tabular data pipelines as lazily evaluated Spark plans."""

__version__ = "0.1.0"
