"""Readers and writers, and the catalog of a raster data source."""
