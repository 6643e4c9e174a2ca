"""Training-data operators: dedup, joins, packing, mixing, sharding, scoring.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only if it is there.
"""
