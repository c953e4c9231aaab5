"""threadloom: analytics over discussion-forum corpora and the graphs derived from them, on PySpark."""

__version__ = "0.1.0"
