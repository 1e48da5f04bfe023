"""Loomstead: project intelligence (indexing, search, contracts, knowledge records) as Spark DataFrames."""

__version__ = "0.1.0"
