"""kvlake: build, compress, store and query collections of key/value vector caches with Spark DataFrames."""

__version__ = "0.1.0"
