"""evidra: evidence analytics on Spark (DataFrame-first)."""

__version__ = "0.1.0"
