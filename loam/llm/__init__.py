"""Training-data operators: deduplication, decontamination, packing, sharding and scoring.

Self-contained: nothing outside this subpackage imports it.
"""
