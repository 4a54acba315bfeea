"""Operators from grids to grids and from feature tables to tables."""
