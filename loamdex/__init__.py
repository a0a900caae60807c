"""A source-text index and navigation engine on Spark DataFrames."""

__version__ = "0.1.0"
