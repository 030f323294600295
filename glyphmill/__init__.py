"""glyphmill: text retrieval and data-preparation analytics on PySpark."""

__version__ = "0.1.0"
