"""blockflow: census block migration and cross-filter analytics on Spark DataFrames."""

__version__ = "0.1.0"
