"""Whole analyses as one lazy plan each, and the query catalogue."""
