"""Scans, file formats, sinks and the tables derived from the star schema."""
