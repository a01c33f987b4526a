"""Ordered computations over groups of any length.

A plain window sorts a whole group in one task. Here the rows are cut into sort ranges of their key and
order; range summaries are small, get their own window, and are joined back to the rows. The bounds are
sampled from the rows, so a long group falls into many ranges, and rows that share a position are parted
by the rest of the order and, where that ties too, by a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.plans.keyed import join_null_safe
from evalspark.session import materialize

_RANGE = "_range"


def _tie_break(df: DataFrame) -> Column:
    """Hash of all columns that can be hashed; parts rows whose order is equal."""
    flat = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, T.VariantType)]
    return F.xxhash64(*flat)


def in_ranges(df: DataFrame, keys: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """Sort ranges of the rows by ``keys`` and ``order``, written once so that they stay fixed.

    Spark samples the range bounds; a long group falls into several ranges. The range number
    is kept in a written table because every later step must see the same one, also after an
    executor was lost.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order, _tie_break(df)).withColumn(_RANGE, F.spark_partition_id())
    return materialize(ranged, name)


def running_sums(df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``measures`` per key in ``order``: a row's sum is the one inside its
    sort range plus the totals of the earlier ranges."""
    named = df
    for name, expr in measures.items():
        named = named.withColumn(name, expr.cast("long"))
    ranged = in_ranges(named, keys, order)
    inside = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, _RANGE).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select(
        *keys, _RANGE, *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_{m}_before") for m in measures]
    )
    local = ranged.withColumns({m: F.sum(m).over(inside) for m in measures})
    joined = join_null_safe(local, offsets, [*keys, _RANGE])
    kept = [c for c in df.columns if c not in measures]
    return joined.select(*kept, *[(F.col(m) + F.col(f"_{m}_before")).alias(m) for m in measures])


def previous_values(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Add the preceding row's values per key: ``columns`` maps a source to its new name.

    The first row of a range takes the last row of the key's range before. Rows that tie in ``order`` follow
    each other by a hash of the row.
    """
    ranged = in_ranges(df.withColumn("_tie", _tie_break(df)), keys, [*order, "_tie"])
    inside = Window.partitionBy(*keys, _RANGE).orderBy(*order, "_tie")
    carried = F.struct(*[F.col(c).alias(c) for c in columns])
    place = [F.col(c).alias(f"o{i}") for i, c in enumerate([*order, "_tie"])]
    last = ranged.groupBy(*keys, _RANGE).agg(F.max(F.struct(*place, carried.alias("v"))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(_RANGE)
    edges = last.select(*keys, _RANGE, F.lag("_last.v").over(earlier).alias("_edge"))
    local = ranged.withColumn("_prev", F.lag(carried).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    joined = join_null_safe(local, edges, [*keys, _RANGE])
    chosen = F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_prev"))
    return joined.select(*df.columns, *[chosen[c].alias(name) for c, name in columns.items()])


def rank_rows(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """``row_number`` per key for groups of any length."""
    return running_sums(df, keys, order, {rank: F.lit(1)})


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Exact medians of several columns per key, by one plan for groups of any size.

    ``percentile`` keeps every distinct value of a group in one buffer. Here equal values are counted first
    and the counts get running sums over sort ranges, so a group's values are never together in a task.
    NULL values don't count; a key without values has no row.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("_m"), v.cast("double").alias("_v")) for n, v in values.items()])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p._m", "_p._v")
    group = [*keys, "_m"]
    counts = long.filter(F.col("_v").isNotNull()).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(counts, group, ["_v"], {"_hi": F.col("_c")})
    sizes = ranked.groupBy(*group).agg(F.max("_hi").alias("_n"))
    first, last = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    low, high = F.col("_hi") - F.col("_c"), F.col("_hi")
    holds = lambda rank: F.max(F.when((rank > low) & (rank <= high), F.col("_v")))
    middle = join_null_safe(ranked, sizes, group).groupBy(*group).agg(holds(first).alias("_a"), holds(last).alias("_b"))
    return middle.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_m") == n, (F.col("_a") + F.col("_b")) / 2)).alias(n) for n in values]
    )
