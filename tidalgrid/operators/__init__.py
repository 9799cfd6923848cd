"""Operators on fields, tracks, graphs and voyages."""
