"""Training-data operators: deduplication, filtering, tokenising, scoring, packing, search.

Nothing outside this subpackage imports it.
"""
