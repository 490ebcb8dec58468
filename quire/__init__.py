"""quire: documents, pages and their parts as Spark DataFrames."""

__version__ = "0.1.0"
