"""Collects the queries and their SQL."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and the SQL it must equal."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add
