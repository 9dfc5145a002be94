"""Training-data operators: search, filtering, tokenising, deduplication, packing.

Nothing outside this subpackage imports it.
"""
