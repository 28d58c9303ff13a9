"""The list of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from harborlight import session
from harborlight.oracle import compose
from harborlight.sources.derived import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(session.tune(spark), sf_dir))


_QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` with the ids it covers."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, tuple(covers.split()), build, oracle)
        return build

    return register


def all_queries() -> dict[str, Query]:
    from harborlight import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"harborlight.plans.{module.name}")
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return {name: compose(q.oracle) for name, q in all_queries().items() if q.oracle}
