"""Raster time-series analytics on Spark DataFrames."""
