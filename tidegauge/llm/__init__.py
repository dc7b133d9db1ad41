"""Training-data operators: dedup, formatting, mixing, archives, filters and scoring.

Nothing outside this subpackage imports it, so the rest of the library works without it.
"""
