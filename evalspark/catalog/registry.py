"""Registered queries: one Spark query and, where SQL can say it, the equivalent check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.catalog.inputs import Inputs, with_inputs
from evalspark.session import configure


@dataclass
class Query:
    build: Callable[[Inputs], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    longs: tuple[str, ...]
    extra: dict[str, str]
    digits: int


@dataclass
class Registry:
    entries: dict[str, Query] = field(default_factory=dict)

    def add(
        self,
        name: str,
        build: Callable[[Inputs], DataFrame],
        sql: str | None = None,
        doubles: str = "",
        longs: str = "",
        extra: dict[str, str] | None = None,
        digits: int = 4,
    ) -> None:
        """Register ``name``. Listed double columns are rounded and listed counts are made bigint
        on both sides, since the engines add floating point values in different orders."""
        if name in self.entries:
            raise ValueError(f"duplicate query {name}")
        self.entries[name] = Query(build, sql, tuple(doubles.split()), tuple(longs.split()), extra or {}, digits)

    def run(self, name: str, spark: SparkSession, folder: str) -> DataFrame:
        entry = self.entries[name]
        out = entry.build(Inputs(configure(spark), folder))
        for c in entry.doubles:
            out = out.withColumn(c, F.round(F.col(c).cast("double"), entry.digits) + F.lit(0.0))
        for c in entry.longs:
            out = out.withColumn(c, F.col(c).cast("bigint"))
        return out

    def oracle(self, name: str) -> str | None:
        entry = self.entries[name]
        if entry.sql is None:
            return None
        changed = [
            f"round(cast({c} as double), {entry.digits}) + cast(0 as double) as {c}" for c in entry.doubles
        ] + [f"cast({c} as bigint) as {c}" for c in entry.longs]
        body = entry.sql.strip()
        if changed:
            return with_inputs(f"select * replace ({', '.join(changed)}) from ({body}) _q", entry.extra)
        return with_inputs(body, entry.extra)
