"""Training-data operators: scoring, cleaning, deduplication, archives, mixing and token output.

Nothing outside this subpackage imports it; it may be removed as a whole.
"""
