"""Training-data operators: deduplication, scoring, tokenisation, scanning and mixing.

Nothing outside this subpackage imports it.
"""
