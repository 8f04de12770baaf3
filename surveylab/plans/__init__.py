"""Composed plans over the driver tables and the query catalogue."""
