"""Training-data operators: filters, deduplication, pseudonyms, mixing and packing.

Nothing else in the library imports this subpackage.
"""
