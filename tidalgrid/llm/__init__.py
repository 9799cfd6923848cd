"""Training-data operators: counting, deduplication, decontamination, packing, scans and scoring.

Nothing else in the library imports this subpackage; see ``queries.py`` for the registered queries.
"""
