"""Flood-risk and geospatial analytics on Spark DataFrames."""
