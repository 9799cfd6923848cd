"""Gridded fields, voyages and navigable water as Spark DataFrames."""
