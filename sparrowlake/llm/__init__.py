"""Training-data operators: deduplication, decontamination, scoring, filtering and mixing.

Nothing outside this package imports it.
"""
