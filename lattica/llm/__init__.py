"""Training-data operators: packing, token counts, near-dedup, filters, scoring, sharding.

Nothing else in the library imports this subpackage.
"""
