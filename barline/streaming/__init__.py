"""Incremental refresh in place of polling."""
