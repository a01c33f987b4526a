"""Per-key selections that stay safe when one key holds a large share of the rows.

They are aggregates over ``struct`` values, so every task reduces its own rows to one
candidate per key before anything is shuffled. A window would send all rows of a hot
key to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick_per_key(df: DataFrame, keys: list[str], order: list[str], largest: bool = True) -> DataFrame:
    """One row per key: the largest (or smallest) by ``order``, ties by all other columns.

    NULL order values lose when ``largest`` is set.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = order + [c for c in rest if c not in order]
    pick = F.max if largest else F.min
    best = df.groupBy(*keys).agg(pick(F.struct(*ranked)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, full tie-break on the remaining columns."""
    return pick_per_key(df, keys, order, largest=True)


def spread(df: DataFrame, keys: list[str], ways: int = 16) -> DataFrame:
    """Rows dealt over all tasks by ``keys`` and a share of the row's hash, so that a hot key goes to several tasks.

    An aggregate with texts in its values sorts its rows, first where they are read. One task may read a file's largest
    piece alone and would sort all of it; after this it sorts a task's share of the rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, T.VariantType)]
    return df.repartition(parts, *keys, F.pmod(F.xxhash64(*hashed), F.lit(ways)))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_name: str = "rank") -> DataFrame:
    """First ``n`` rows per key.

    The ``row_number() <= n`` form lets Spark keep only ``n`` rows per key and task
    before the shuffle, so a hot key never reaches one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(window)).filter(F.col(rank_name) <= n)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the key columns of ``left`` are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def add_missing(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key has no row in ``other`` (NULL keys never match)."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")
