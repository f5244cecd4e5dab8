"""Readers and writers: LAS tiles, rasters, text tables, training scenes and project folders."""
