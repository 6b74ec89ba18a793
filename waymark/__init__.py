"""Geospatial analytics and route optimisation on Spark DataFrames."""

__version__ = "0.1.0"
