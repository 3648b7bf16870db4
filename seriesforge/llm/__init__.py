"""Training-data operators: scoring, filtering, deduplication, mixing, packing and token files.

Nothing else in the library imports this subpackage.
"""
