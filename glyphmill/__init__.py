"""glyphmill: corpus statistics and byte-pair-encoding training on Spark DataFrames."""

__version__ = "0.1.0"
