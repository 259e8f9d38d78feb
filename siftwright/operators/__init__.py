"""Filters over frames, and named lists."""
