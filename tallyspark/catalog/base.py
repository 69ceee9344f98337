"""Registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans.fixtures import Inputs, oracle_cte


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Inputs(spark, sf_dir))

    def oracle(self) -> str | None:
        return oracle_cte(self.sql) if self.sql else None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query builder; `sql` may name driver tables and derived views."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register
