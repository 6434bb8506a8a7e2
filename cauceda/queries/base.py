from __future__ import annotations


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Register:
    """Collects the queries of a module: ``@register(sql)`` takes the function's name as the query's."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None):
        def add(run):
            self.queries[run.__name__] = run
            if sql:
                self.oracles[run.__name__] = sql
            return run

        return add
