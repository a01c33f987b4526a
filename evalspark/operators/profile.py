"""Table profiling and relationship discovery, one pass per table and one value table for all.

All functions take ``tables``: table name to DataFrame. Nested columns are left out.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.plans.keyed import top_n
from evalspark.session import materialize

# Thresholds of the profile.
CATEGORICAL_LIMIT = 20
CONTIGUOUS_SHARE = 0.6
CATEGORICAL_SAMPLES = 10
PATTERN_SAMPLES = 20
PATTERN_SHARE = 0.8
PERMUTATIONS = 128
SIMILARITY_LIMIT = 0.5
ORPHAN_SAMPLES = 10
# Text patterns in order of precedence.
TEXT_PATTERNS = [
    ("email", r"(?i)^[^@\s]+@[^@\s]+\.[^@\s]+$"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("url", r"(?i)^https?://"),
    ("phone", r"^[\+]?[(]?[0-9]{1,3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}$"),
    ("date_string", r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-/]\d{2}[-/]\d{4}|\d{2}[-/]\d{2}[-/]\d{2})$"),
]
# Spark type to the SQL type name that role rules are written in
_TYPE_NAMES = {
    "tinyint": "TINYINT",
    "smallint": "SMALLINT",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def flat_columns(df: DataFrame) -> list[T.StructField]:
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f for f in df.schema.fields if not isinstance(f.dataType, nested)]


def type_name(data_type: T.DataType) -> str:
    simple = data_type.simpleString()
    return _TYPE_NAMES.get(simple, simple.upper())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- values


def column_values(
    tables: dict[str, DataFrame], key_length: int | None = None, columns: dict[str, list[str]] | None = None
) -> DataFrame:
    """(table, column, value, n) with one row per distinct value, NULL included.

    With ``key_length`` longer values are replaced by a hash, for counting and set work. ``columns`` names those to take per table.
    """

    def text(field: T.StructField) -> Column:
        value = F.col(field.name).cast("string")
        if key_length is None or not isinstance(field.dataType, T.StringType):
            return value
        return F.when(F.length(value) > key_length, F.concat(F.lit("#"), F.sha2(value, 256))).otherwise(value)

    parts = []
    for name, df in tables.items():
        fields = [f for f in flat_columns(df) if columns is None or f.name in columns.get(name, [])]
        if not fields and columns is not None:
            continue
        cells = F.array(*[F.struct(F.lit(f.name).alias("column"), text(f).alias("value")) for f in fields])
        parts.append(
            df.select(F.explode(cells).alias("c"))
            .groupBy("c.column", "c.value")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("table"), "column", "value", "n")
        )
    if not parts and tables:
        none = next(iter(tables.values())).sparkSession
        return none.createDataFrame([], "table string, column string, value string, n long")
    return _union(parts)


def namesakes(tables: dict[str, DataFrame], prefix: str = "") -> dict[str, list[str]]:
    """The columns per table whose name, without case and ``prefix``, some other table has as well: all that ``orphan_values`` looks at."""
    name = lambda c: re.sub(prefix, "", c.lower()) if prefix else c.lower()
    held: dict[str, set[str]] = {}
    for table, df in tables.items():
        for f in flat_columns(df):
            held.setdefault(name(f.name), set()).add(table)
    return {table: [f.name for f in flat_columns(df) if len(held[name(f.name)]) > 1] for table, df in tables.items()}


def distinct_counts(values: DataFrame) -> DataFrame:
    return values.groupBy("table", "column").agg(F.count("value").alias("unique_count"))


def sample_values(values: DataFrame, limits: DataFrame | None = None, n: int = PATTERN_SAMPLES) -> DataFrame:
    """Smallest distinct values per column; ``limits`` (table, column, wanted) sets the number."""
    known = values.filter(F.col("value").isNotNull()).select("table", "column", "value")
    first = top_n(known, ["table", "column"], [F.col("value")], n)
    if limits is not None:
        first = first.join(limits, ["table", "column"]).filter(F.col("rank") <= F.col("wanted"))
    return first.groupBy("table", "column").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))


def smallest_values(tables: dict[str, DataFrame], n: int = PATTERN_SAMPLES) -> DataFrame:
    """(table, column, value) of the ``n`` smallest distinct values per column.

    Every task keeps ``n`` values per column while it reads its rows, so nothing but these is shuffled.
    """

    def kept(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        best: dict[str, pa.Array] = {}
        for batch in batches:
            for name in batch.schema.names:
                new = batch.column(name).drop_null()
                old = best.get(name)
                if old is not None and len(old) == n:
                    new = new.filter(pc.less(new, old[-1]))
                if old is not None:
                    new = pa.concat_arrays([old, new])
                distinct = pc.unique(new)
                best[name] = distinct.take(pc.sort_indices(distinct)[:n])
        for name, values in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), values], ["column", "value"])

    parts = []
    for name, df in tables.items():
        cells = df.select(*[F.col(f.name).cast("string").alias(f.name) for f in flat_columns(df)])
        found = cells.mapInArrow(kept, "column string, value string")
        parts.append(found.select(F.lit(name).alias("table"), "column", "value"))
    return _union(parts).distinct()


# ---------------------------------------------------------------- profile


def _finest_clock_part(field: T.StructField) -> Column:
    """The finest part of the time of day that any value of a time column uses; day for dates."""
    c = F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return F.when(F.count(c) > 0, "day")
    if not isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(None).cast("string")
    return (
        F.when(F.bool_or(F.date_part(F.lit("SECOND"), c) != 0), "second")
        .when(F.bool_or(F.minute(c) != 0), "minute")
        .when(F.bool_or(F.hour(c) != 0), "hour")
        .when(F.count(c) > 0, "day")
    )


def _column_stats(field: T.StructField) -> Column:
    c = F.col(field.name)
    numeric = isinstance(field.dataType, T.NumericType)
    is_text = isinstance(field.dataType, T.StringType)
    none = F.lit(None)
    quantiles = F.percentile_approx(c.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if numeric else none

    def letters(pattern: str) -> Column:
        return F.sum(F.length(F.regexp_replace(c, pattern, "")))

    return F.struct(
        F.lit(field.name).alias("column"),
        F.lit(type_name(field.dataType)).alias("dtype"),
        F.min(c).cast("string").alias("min_value"),
        F.max(c).cast("string").alias("max_value"),
        F.approx_count_distinct(c).alias("approx_unique"),
        (F.avg(c) if numeric else none).cast("double").alias("avg"),
        (F.stddev(c) if numeric else none).cast("double").alias("std"),
        quantiles.cast("array<double>").alias("q"),
        F.count(F.lit(1)).alias("count"),
        F.count_if(c.isNull()).alias("nulls"),
        (F.min(F.length(c)) if is_text else none).cast("bigint").alias("min_length"),
        (F.max(F.length(c)) if is_text else none).cast("bigint").alias("max_length"),
        (F.sum(F.length(c)) if is_text else none).cast("bigint").alias("sum_length"),
        (letters("[^a-zA-Z]+") if is_text else none).cast("bigint").alias("alpha"),
        (letters("[^0-9]+") if is_text else none).cast("bigint").alias("digits"),
        (F.array(*[F.count_if(c.rlike(p)) for _, p in TEXT_PATTERNS]) if is_text else none).cast("array<bigint>").alias("hits"),
        _finest_clock_part(field).alias("finest_part"),
    )


def column_statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """All statistics of all columns, one aggregate per table."""
    parts = []
    for name, df in tables.items():
        row = df.agg(F.array(*[_column_stats(f) for f in flat_columns(df)]).alias("s"))
        parts.append(row.select(F.lit(name).alias("table"), F.explode("s").alias("c")).select("table", "c.*"))
    stats = _union(parts)
    share = F.try_divide(F.col("alpha"), F.nullif("sum_length", F.lit(0)))
    digits = F.try_divide(F.col("digits"), F.nullif("sum_length", F.lit(0)))
    is_text = F.col("sum_length").isNotNull() | (F.col("dtype") == "VARCHAR")
    alpha_ratio, digit_ratio = F.coalesce(share, F.lit(0.0)), F.coalesce(digits, F.lit(0.0))
    special = F.greatest(F.lit(0.0), 1.0 - alpha_ratio - digit_ratio)
    return stats.select(
        "table",
        "column",
        "dtype",
        "min_value",
        "max_value",
        "approx_unique",
        "avg",
        "std",
        F.get("q", F.lit(0)).alias("q25"),
        F.get("q", F.lit(1)).alias("q50"),
        F.get("q", F.lit(2)).alias("q75"),
        "count",
        F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("count")), F.lit(0.0)).alias("null_percentage"),
        "min_length",
        "max_length",
        F.try_divide(F.col("sum_length"), F.col("count") - F.col("nulls")).alias("avg_length"),
        F.when(is_text, F.round(alpha_ratio, 2)).alias("alpha_ratio"),
        F.when(is_text, F.round(digit_ratio, 2)).alias("numeric_ratio"),
        F.when(is_text, F.round(special, 2)).alias("special_ratio"),
        detect_pattern(F.col("hits"), F.col("count") - F.col("nulls")).alias("detected_pattern"),
        "finest_part",
    )


def contiguous_from_zero(unique: Column) -> Column:
    """Values cover most of 0..max with max above one: a count rather than a code."""
    low, high = F.col("min_value").try_cast("double"), F.col("max_value").try_cast("double")
    return F.coalesce((low == 0) & (high > 1) & (unique >= (high + 1) * CONTIGUOUS_SHARE), F.lit(False))


def categorical_flag(stats: DataFrame) -> DataFrame:
    """At most 20 distinct values, except contiguous counts starting at zero."""
    unique = F.col("unique_count")
    few = unique <= CATEGORICAL_LIMIT
    counted = (F.col("dtype") != "VARCHAR") & contiguous_from_zero(unique)
    return stats.withColumn("is_categorical", few & ~counted)


def detect_pattern(hits: Column, known: Column) -> Column:
    """Name of the first pattern that at least 80 percent of a column's values match.

    ``hits`` holds the number of matching values per pattern, ``known`` the number of values.
    """
    chain = None
    for place, (name, _) in enumerate(TEXT_PATTERNS):
        match = (known > 0) & (F.get(hits, F.lit(place)) >= known * F.lit(PATTERN_SHARE))
        chain = F.when(match, name) if chain is None else chain.when(match, name)
    return chain


def profile_columns(tables: dict[str, DataFrame], exact: bool = False, values: DataFrame | None = None) -> DataFrame:
    """Full profile per column: one aggregate and one pass for the samples per table.

    ``exact`` counts distinct values instead of estimating them, which shuffles every distinct value (long
    texts as hashes); ``values`` are these, where a caller has them written already.
    """
    stats = column_statistics(tables)
    if exact:
        values = column_values(tables, key_length=64) if values is None else values
        stats = stats.join(distinct_counts(values), ["table", "column"])
    else:
        stats = stats.withColumn("unique_count", F.col("approx_unique"))
    flagged = materialize(categorical_flag(stats), "statistics")
    wanted = F.when(F.col("is_categorical"), F.least(F.col("unique_count"), F.lit(CATEGORICAL_SAMPLES))).when(
        F.col("dtype") == "VARCHAR", F.lit(PATTERN_SAMPLES)
    )
    limits = flagged.select("table", "column", wanted.alias("wanted")).filter("wanted > 0")
    return flagged.join(sample_values(smallest_values(tables), limits), ["table", "column"], "left")


# ---------------------------------------------------------------- similarity


def minhash_signature(values: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """Smallest hash per seed over the distinct values of each column; single-valued columns skipped."""
    known = values.filter(F.col("value").isNotNull())
    mins = F.array(*[F.min(F.xxhash64(F.lit(seed), F.col("value"))) for seed in range(permutations)])
    signed = known.groupBy("table", "column").agg(F.count(F.lit(1)).alias("unique_count"), mins.alias("signature"))
    return signed.filter(F.col("unique_count") > 1)


def column_similarity(signatures: DataFrame, threshold: float = SIMILARITY_LIMIT, rows: int = 2) -> DataFrame:
    """Column pairs of different tables with an estimated Jaccard similarity above the threshold.

    Signatures are cut into bands of ``rows`` places. Columns that agree in a whole band are compared, place by
    place and once; a pair of similarity 0.5 is missed with a probability of 0.75 ** 64, 1e-8. ``rows`` = 1
    compares all columns that share a place.
    """
    bands = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("signature") - 1) / rows).cast("int")),
        lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", i * rows + 1, F.lit(rows))).alias("bucket")),
    )
    placed = signatures.select("table", "column", F.explode(bands).alias("b"))
    meeting = placed.groupBy("b").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("cols"))
    candidates = _pairs_of_sets(meeting.filter(F.size("cols") > 1).select("cols").distinct().withColumn("n", F.lit(1))).drop("n")
    pairs = candidates
    for side in ("source", "target"):
        own = [F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"), F.col("signature").alias(f"_{side}")]
        pairs = pairs.join(signatures.select(*own), [f"{side}_table", f"{side}_column"])
    equal = F.size(F.filter(F.zip_with("_source", "_target", lambda a, b: a == b), lambda same: same))
    similarity = F.round(equal / F.size("_source"), 3)
    keys = ["source_table", "source_column", "target_table", "target_column"]
    return pairs.select(*keys, similarity.alias("jaccard_similarity")).filter(F.col("jaccard_similarity") >= threshold)


def _pairs_of_sets(sets: DataFrame) -> DataFrame:
    """Shared counts per pair of columns from (set of columns, n).

    A set holds columns of the schema, so it is small whatever the data size; equal sets were
    counted before, so few sets are expanded.
    """
    left = sets.select("cols", "n", F.explode("cols").alias("a"))
    both = left.select("n", "a", F.explode("cols").alias("b"))
    ordered = both.filter(F.col("a.table") < F.col("b.table"))
    return ordered.groupBy(
        F.col("a.table").alias("source_table"),
        F.col("a.column").alias("source_column"),
        F.col("b.table").alias("target_table"),
        F.col("b.column").alias("target_column"),
    ).agg(F.sum("n").alias("n"))


def _column_sets(values: DataFrame) -> DataFrame:
    """The set of columns every value occurs in."""
    known = values.filter(F.col("value").isNotNull())
    return known.groupBy("value").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("cols"))


def column_jaccard_exact(values: DataFrame) -> DataFrame:
    """Exact Jaccard similarity and containment of all column pairs that share a value."""
    sets = _column_sets(values).groupBy("cols").agg(F.count(F.lit(1)).alias("n"))
    shared = _pairs_of_sets(sets)
    sizes = distinct_counts(values)
    source = sizes.select(
        F.col("table").alias("source_table"), F.col("column").alias("source_column"), F.col("unique_count").alias("source_unique")
    )
    target = sizes.select(
        F.col("table").alias("target_table"), F.col("column").alias("target_column"), F.col("unique_count").alias("target_unique")
    )
    joined = shared.join(source, ["source_table", "source_column"]).join(target, ["target_table", "target_column"])
    union = F.col("source_unique") + F.col("target_unique") - F.col("n")
    return joined.select(
        "source_table",
        "source_column",
        "target_table",
        "target_column",
        "source_unique",
        "target_unique",
        F.col("n").alias("shared"),
        F.round(F.col("n") / union, 3).alias("jaccard_similarity"),
        F.round(F.col("n") / F.least("source_unique", "target_unique"), 3).alias("containment"),
    )


def classify_relationship(similarity: Column, source_unique: Column, target_unique: Column) -> Column:
    ratio = F.try_divide(F.least(source_unique, target_unique), F.greatest(source_unique, target_unique))
    uneven = F.coalesce(ratio < 0.5, F.lit(True))
    return (
        F.when((similarity >= 0.9) & uneven, "foreign_key")
        .when(similarity >= 0.7, "shared_dimension")
        .otherwise("partial_overlap")
    )


def with_relationship(pairs: DataFrame, measure: str = "jaccard_similarity") -> DataFrame:
    """Add the likely relationship. On whole columns a foreign key cannot reach a Jaccard similarity
    of 0.9 with uneven cardinalities; ``measure="containment"`` finds it."""
    kind = classify_relationship(F.col(measure), F.col("source_unique"), F.col("target_unique"))
    return pairs.withColumn("likely_relationship", kind)


def orphan_values(values: DataFrame, samples: int = ORPHAN_SAMPLES, prefix: str = "") -> DataFrame:
    """Values that only one of two equally named columns holds, counted and sampled in both directions.

    ``prefix`` is a pattern of table prefixes that do not count as part of a name, like ``^[a-z]_``.
    """
    # read for the columns and for their sets; written once, so that whole texts are gathered once
    values = materialize(values.select("table", "column", "value"), "values")
    name = F.lower("column") if not prefix else F.regexp_replace(F.lower("column"), prefix, "")
    columns = values.select("table", "column").distinct().withColumn("_name", name)
    partners = columns.select(
        F.col("column").alias("other_column"), F.col("table").alias("other_table"), F.col("_name").alias("_other")
    )
    pairs = columns.join(
        partners, (F.col("_name") == F.col("_other")) & (F.col("table") != F.col("other_table"))
    ).select("table", "column", "other_table", "other_column")
    # pairs of columns are few whatever the size: joined by their names they would bring all values of a column to one task
    pairs = F.broadcast(pairs)
    paired = values.join(F.broadcast(pairs.select("table", "column").distinct()), ["table", "column"], "left_semi")
    sets = _column_sets(paired)
    exploded = sets.select("value", "cols", F.explode("cols").alias("a")).select("value", "cols", "a.table", "a.column")
    missing = exploded.join(pairs, ["table", "column"]).filter(
        ~F.array_contains("cols", F.struct(F.col("other_table").alias("table"), F.col("other_column").alias("column")))
    )
    keys = ["table", "column", "other_table", "other_column"]
    counts = missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("orphan_count"))
    first = top_n(missing.select(*keys, "value"), keys, [F.col("value")], samples).groupBy(*keys).agg(
        F.array_sort(F.collect_list("value")).alias("orphan_sample")
    )
    return counts.join(first, keys)
