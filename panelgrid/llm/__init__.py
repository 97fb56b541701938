"""Training-data operators: tokenising, deduplication, redaction, filtering, packing and scoring.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered queries.
"""
