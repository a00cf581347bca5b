"""attestor: batch text-provenance verification on Spark DataFrames."""

__version__ = "0.1.0"
