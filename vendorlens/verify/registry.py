"""Queries by key, each with the SQL that gives the same result on the given tables."""

QUERIES = {}
ORACLES = {}


def register(key, sql=None):
    """Adds a query ``fn(spark, sf)``; ``sql`` is its counterpart, absent where SQL cannot say it."""
    def add(fn):
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn
    return add
