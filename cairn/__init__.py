"""Analytics over stored objects, as Spark DataFrame operations.

functions: scalar and predicate semantics as Column expressions; sources: readers and writers of
delimited text, JSON records, Parquet and Arrow; operators: listings, tag search, ranges, manifests,
inventory, lifecycle and request logs; streaming: hourly request logs; plans: the registered queries.
"""
