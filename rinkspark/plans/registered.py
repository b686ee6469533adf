"""Registration of queries: a function of the folder's tables and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rinkspark.session import Dataset


class Queries:
    def __init__(self):
        self.made: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Decorates ``f(tables)`` as the query ``name``."""

        def add(f: Callable[[Dataset], DataFrame]):
            if name in self.made:
                raise ValueError(f"registered twice: {name}")
            self.made[name] = lambda spark, sf_dir: f(Dataset(spark, sf_dir))
            if sql:
                self.sql[name] = sql
            return f

        return add

    def take(self, other: Queries) -> None:
        if twice := self.made.keys() & other.made.keys():
            raise ValueError(f"registered twice: {twice}")
        self.made |= other.made
        self.sql |= other.sql
