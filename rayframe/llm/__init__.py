"""Training-data operators: deduplication, language ID, extraction, tokenisation, scoring, packing.

Nothing else in the library imports this subpackage.
"""
