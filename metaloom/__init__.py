"""metaloom: document metadata extraction, contracts and profiling on Spark DataFrames."""

__version__ = "0.1.0"
