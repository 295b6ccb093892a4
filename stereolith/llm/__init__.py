"""Training-data operators: packing, scoring, filtering, search, sharding.

Nothing else in the library imports this subpackage.
"""
