"""fabula: text-corpus and experiment analytics on PySpark DataFrames."""

__version__ = "0.1.0"
