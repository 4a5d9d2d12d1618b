"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from leafwork.sources.fixtures import frame, oracle

Query = Callable[[SparkSession, str], DataFrame]
#: The modules of this package that register queries.
MODULES = "scans scalars assembly layout revisions redaction ocr annotations rules graphs history".split()
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


class Tables:
    """The inputs of a query: ``t.page`` is the view or table of that name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Registers a function of the tables under its own name, with the SQL that gives the same rows, where there is any."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _sql[name] = oracle(sql)
        return f

    return register


@cache
def _load() -> None:
    for module in MODULES:
        import_module(f"leafwork.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
