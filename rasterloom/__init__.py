"""Raster analytics on Spark: imagery as DataFrames of tiles and pixels."""
