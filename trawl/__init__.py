"""trawl: regular-expression search, counting and analysis of text columns on Spark."""

__version__ = "0.1.0"
