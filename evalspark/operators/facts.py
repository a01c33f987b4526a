"""Facts about columns and tables, derived from profiles and the query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.profile import contiguous_from_zero
from evalspark.plans.keyed import pick_per_key, top_n
from evalspark.session import materialize

UNIQUE_SHARE = 0.95
USAGE_MINIMUM = 5
FACT_CHARS = 120
ENUM_VALUES = 5
ORPHAN_VALUES = 3
NULL_LIMIT = 5.0
ANNOTATION_LENGTH = 200
# Parts of names that mark a measure.
MEASURE_WORDS = [
    "amount", "price", "cost", "total", "sum", "count", "qty", "quantity", "value", "revenue", "sales", "profit",
    "rate", "score", "weight", "height", "length", "width", "size", "duration", "distance", "percent", "ratio",
    "average", "avg", "num_", "n_",
]
# Words an annotation may add to a column name without saying anything.
FILLER_WORDS = [
    "the", "this", "that", "is", "are", "was", "were", "for", "and", "of", "in", "to", "a", "an", "column", "field",
    "value", "values",
]
_INTEGERS = ["BIGINT", "INTEGER", "INT", "SMALLINT", "TINYINT"]
_KEY = ["table", "column"]


# Key names.
_KEY_NAME = "^(id|pk|key)$|(_id|_pk|_key|id)$|^(pk_|id_)"


def has_key_name(name: Column) -> Column:
    return F.lower(name).rlike(_KEY_NAME)


def detect_primary_key(profile: DataFrame) -> DataFrame:
    """Nearly unique and named like a key."""
    unique = F.col("unique_count") >= F.col("count") * F.lit(UNIQUE_SHARE)
    flag = (F.col("count") > 0) & (F.col("unique_count") > 0) & unique & has_key_name(F.col("column"))
    return profile.withColumn("is_primary_key", flag)


def semantic_role(confirmed: Column, joined: Column) -> Column:
    """pk, fk, timestamp, fact or dimension; the first rule that applies."""
    name, dtype = F.lower("column"), F.upper("dtype")
    integer = dtype.isin(_INTEGERS)
    id_name = (name.endswith("_id") | (name.endswith("id") & (name != "id"))) & dtype.isin(_INTEGERS[:3])
    measure = name.rlike("|".join(MEASURE_WORDS))
    return (
        F.when(F.col("is_primary_key"), "pk")
        .when(confirmed, "fk")
        .when(id_name, "fk")
        .when(dtype.rlike("DATE|TIME"), "timestamp")
        .when(dtype.rlike("DECIMAL|DOUBLE|FLOAT|REAL|NUMERIC"), "fact")
        .when(integer & measure, "fact")
        .when(integer & contiguous_from_zero(F.col("unique_count")), "fact")
        .when(integer & joined & has_key_name(F.col("column")), "fk")
        .when(F.col("is_categorical"), "dimension")
        .when(dtype.rlike("VARCHAR|TEXT|CHAR"), "dimension")
    )


def date_granularity(profile: DataFrame) -> DataFrame:
    """day, hour, minute or second for date and time columns, from all their values; day without values."""
    timed = F.upper("dtype").rlike("DATE|TIME")
    return profile.withColumn("date_granularity", F.when(timed, F.coalesce("finest_part", F.lit("day"))))


def column_granularity(df: DataFrame, column: str) -> DataFrame:
    """Finest time part in use over the whole column."""
    c = F.col(column)
    return df.agg(
        F.when(F.bool_or(F.date_part(F.lit("SECOND"), c) != 0), "second")
        .when(F.bool_or(F.minute(c) != 0), "minute")
        .when(F.bool_or(F.hour(c) != 0), "hour")
        .when(F.count(c) > 0, "day")
        .alias("granularity")
    )


# ---------------------------------------------------------------- facts from the log


def usage_flags(usage: DataFrame, minimum: int = USAGE_MINIMUM) -> DataFrame:
    return usage.select(
        *_KEY,
        (F.col("where_count") >= minimum).alias("used_in_where"),
        (F.col("group_by_count") >= minimum).alias("used_in_groupby"),
        (F.col("order_by_count") >= minimum).alias("used_in_orderby"),
        "importance_score",
    )


def column_aggregations(metrics: DataFrame, profile: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent aggregate functions applied to a column, alone or inside an expression.

    Metrics are split into the identifiers they mention, so that columns meet metrics by name.
    """
    words = metrics.select(
        F.upper(F.regexp_extract("expression", r"^(\w+)\s*\(", 1)).alias("function"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("expression"), F.lit(r"([a-z_]\w*)"), F.lit(1)))).alias("word"),
        "occurrence_count",
    ).filter(F.col("function").isin("SUM", "AVG", "COUNT", "MIN", "MAX"))
    columns = profile.select(*_KEY, F.lower("column").alias("word"))
    counts = columns.join(words, "word").groupBy(*_KEY, "function").agg(F.sum("occurrence_count").alias("n"))
    return top_n(counts, _KEY, [F.desc("n"), F.col("function")], n)


def join_targets(joins: DataFrame) -> DataFrame:
    """Both directions of every mined join: (table, column, target table, target column, count)."""

    def side(a: str, b: str) -> DataFrame:
        return joins.select(
            F.col(f"{a}_table").alias("table"),
            F.col(f"{a}_column").alias("column"),
            F.col(f"{b}_table").alias("target_table"),
            F.col(f"{b}_column").alias("target_column"),
            "count",
        )

    return side("left", "right").unionByName(side("right", "left"))


def speculative_joins(similarities: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Foreign key like similarities that no mined join confirms."""
    likely = similarities.filter(F.col("likely_relationship") == "foreign_key")

    def side(a: str, b: str) -> DataFrame:
        return likely.select(
            F.col(f"{a}_table").alias("table"),
            F.col(f"{a}_column").alias("column"),
            F.col(f"{b}_table").alias("target_table"),
            F.col(f"{b}_column").alias("target_column"),
            "jaccard_similarity",
        )

    both = side("source", "target").unionByName(side("target", "source"))
    return both.join(confirmed.select(*_KEY, "target_table", "target_column").distinct(), [*_KEY, "target_table", "target_column"], "left_anti")


def filter_operators(predicates: DataFrame) -> DataFrame:
    """Operators used to filter each column with their frequency."""
    return predicates.groupBy(*_KEY, "operator").agg(F.sum("occurrence_count").alias("n"))


def join_cardinality(targets: DataFrame, profile: DataFrame) -> DataFrame:
    """1:1, 1:N, N:1 or N:N per join, a side being "1" when it is nearly unique."""
    unique = F.col("unique_count") >= F.col("count") * F.lit(UNIQUE_SHARE)
    facts = profile.filter(F.col("count") > 0).select(*_KEY, unique.alias("_one"))
    target = facts.select(F.col("table").alias("target_table"), F.col("column").alias("target_column"), F.col("_one").alias("_other"))
    joined = targets.join(facts, _KEY).join(target, ["target_table", "target_column"])
    text = F.concat(F.when(F.col("_one"), "1").otherwise("N"), F.lit(":"), F.when(F.col("_other"), "1").otherwise("N"))
    return joined.withColumn("join_cardinality", text).drop("_one", "_other")


def orphan_info(similarities: DataFrame, orphans: DataFrame) -> DataFrame:
    """Orphans of the most similar partner of each column."""

    def side(a: str, b: str) -> DataFrame:
        return similarities.select(
            F.col(f"{a}_table").alias("table"),
            F.col(f"{a}_column").alias("column"),
            F.col(f"{b}_table").alias("other_table"),
            F.col(f"{b}_column").alias("other_column"),
            F.col("jaccard_similarity").alias("_j"),
        )

    best = pick_per_key(side("source", "target").unionByName(side("target", "source")), _KEY, ["_j"])
    found = best.join(orphans, [*_KEY, "other_table", "other_column"])
    return found.select(
        *_KEY,
        "orphan_count",
        "orphan_sample",
        F.concat_ws(".", "other_table", "other_column").alias("orphan_target"),
    )


# ---------------------------------------------------------------- assembly


def _joined_top(df: DataFrame, order: list[Column], value: str, n: int, name: str) -> DataFrame:
    """The first ``n`` values per column as an ordered array."""
    first = top_n(df, _KEY, order, n)
    return first.groupBy(*_KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(name)
    )


def schema_facts(
    profile: DataFrame,
    joins: DataFrame,
    usage: DataFrame,
    metrics: DataFrame,
    predicates: DataFrame,
    similarities: DataFrame,
    orphans: DataFrame,
) -> DataFrame:
    """One row of facts per column."""
    # profile, joins and similarities are read by several of the steps below
    profile = materialize(profile, "profile")
    similarities = materialize(similarities, "similarities")
    confirmed = materialize(join_targets(joins), "joins")
    guessed = speculative_joins(similarities, confirmed)
    target_order = [F.desc("_weight"), F.col("target_table"), F.col("target_column")]
    first_confirmed = top_n(confirmed.withColumn("_weight", F.col("count").cast("double")).drop("count"), _KEY, target_order, 1)
    first_guessed = top_n(guessed.withColumnRenamed("jaccard_similarity", "_weight"), _KEY, target_order, 1)
    best = first_confirmed.select(*_KEY, "target_table", "target_column", F.lit(True).alias("confirmed")).unionByName(
        first_guessed.join(first_confirmed.select(*_KEY), _KEY, "left_anti").select(
            *_KEY, "target_table", "target_column", F.lit(False).alias("confirmed")
        )
    )
    target = join_cardinality(best, profile)
    target = best.join(target.select(*_KEY, "join_cardinality"), _KEY, "left")
    based = date_granularity(detect_primary_key(profile))
    parts = [
        target,
        _joined_top(filter_operators(predicates), [F.desc("n"), F.col("operator")], "operator", 3, "filter_operators"),
        usage_flags(usage),
        _joined_top(
            column_aggregations(metrics, profile).drop("rank"), [F.desc("n"), F.col("function")], "function", 3, "aggregations"
        ),
        orphan_info(similarities, orphans),
    ]
    for part in parts:
        based = based.join(part, _KEY, "left")
    known = F.coalesce("confirmed", F.lit(False))
    facts = based.withColumn("semantic_role", semantic_role(known, F.col("target_table").isNotNull()))
    return facts.fillna(False, ["used_in_where", "used_in_groupby", "used_in_orderby", "confirmed"]).fillna(
        0, ["orphan_count", "importance_score"]
    )


def table_facts(facts: DataFrame, joins: DataFrame, guessed: DataFrame) -> DataFrame:
    """Row count, first primary key column and joined tables per table."""
    heads = facts.groupBy("table").agg(
        F.max("count").alias("row_count"),
        F.min(F.when(F.col("is_primary_key"), F.col("column"))).alias("primary_key"),
    )
    targets = join_targets(joins).select("table", "target_table").unionByName(guessed.select("table", "target_table"))
    lists = targets.distinct().groupBy("table").agg(F.array_sort(F.collect_set("target_table")).alias("joins_to"))
    return heads.join(lists, "table", "left")


# ---------------------------------------------------------------- text


def _bracketed(name: str, values: Column) -> Column:
    return F.concat(F.lit(f"{name}:["), F.array_join(values, ","), F.lit("]"))


def format_fact_string(facts: DataFrame, budget: int = FACT_CHARS) -> DataFrame:
    """Compact fact text; the later, less important parts only as far as the budget allows."""
    samples = F.col("sample_values")
    shown = F.array_join(F.slice(samples, 1, ENUM_VALUES), ",")
    cut = (F.size(samples) > ENUM_VALUES) | (F.col("unique_count") > F.size(samples))
    enum = F.when(cut, F.concat(F.lit("enum("), F.col("unique_count").cast("string"), F.lit("):["), shown, F.lit(",...]"))).otherwise(
        F.concat(F.lit("["), shown, F.lit("]"))
    )
    mark = F.when(F.col("confirmed"), "fk").otherwise("fk?")
    card = F.coalesce(F.concat(F.lit("("), F.col("join_cardinality"), F.lit(")")), F.lit(""))
    first = F.filter(
        F.array(
            F.concat(F.lit("role:"), F.col("semantic_role")),
            F.when(F.col("is_categorical") & (F.size(samples) > 0), enum),
            F.concat(mark, card, F.lit("->"), F.col("target_table"), F.lit("."), F.col("target_column")),
            F.when(F.size("aggregations") > 0, _bracketed("agg", F.col("aggregations"))),
        ),
        lambda p: p.isNotNull(),
    )

    def short(column: str) -> Column:
        c = F.col(column)
        return F.when(F.length(c) > 15, F.concat(F.substring(c, 1, 15), F.lit("..."))).otherwise(c)

    used = F.array_compact(
        F.array(
            F.when(F.col("used_in_where"), "where"),
            F.when(F.col("used_in_groupby"), "groupby"),
            F.when(F.col("used_in_orderby"), "orderby"),
        )
    )
    orphan = F.concat(
        F.lit("orphans("),
        F.col("orphan_count").cast("string"),
        F.lit("):["),
        F.array_join(F.slice("orphan_sample", 1, ORPHAN_VALUES), ","),
        F.lit("]->"),
        F.col("orphan_target"),
    )
    more = F.filter(
        F.array(
            F.when(F.col("orphan_count") > 0, orphan),
            F.when(F.col("null_percentage") >= NULL_LIMIT, F.format_string("null:%.0f%%", F.bround("null_percentage", 0))),
            F.when(~F.col("is_categorical"), F.concat(F.lit("range:["), short("min_value"), F.lit(","), short("max_value"), F.lit("]"))),
            F.concat(F.lit("granularity:"), F.col("date_granularity")),
            F.when(F.size("filter_operators") > 0, _bracketed("filter", F.col("filter_operators"))),
            F.when(F.size(used) > 0, _bracketed("used", used)),
            F.concat(F.lit("pattern:"), F.col("detected_pattern")),
        ),
        lambda p: p.isNotNull(),
    )
    start = F.named_struct(
        F.lit("text"), F.array_join("_first", ";"), F.lit("size"), F.aggregate("_first", F.lit(0), lambda n, p: n + F.length(p) + 1)
    )

    def add(state: Column, part: Column) -> Column:
        fits = state["size"] + F.length(part) + 1 < budget
        joined = F.when(F.length(state["text"]) > 0, F.concat(state["text"], F.lit(";"), part)).otherwise(part)
        return F.named_struct(
            F.lit("text"),
            F.when(fits, joined).otherwise(state["text"]),
            F.lit("size"),
            F.when(fits, state["size"] + F.length(part) + 1).otherwise(state["size"]),
        )

    staged = facts.withColumn("_first", first).withColumn("_more", more)
    return staged.withColumn("fact", F.aggregate("_more", start, add)["text"]).drop("_first", "_more")


def format_table_fact(tables: DataFrame) -> DataFrame:
    """``1,000 rows; pk:id; joins:a,b`` per table."""
    text = F.concat_ws(
        "; ",
        F.concat(F.format_number("row_count", 0), F.lit(" rows")),
        F.concat(F.lit("pk:"), F.col("primary_key")),
        F.when(F.size("joins_to") > 0, F.concat(F.lit("joins:"), F.array_join("joins_to", ","))),
    )
    return tables.select("table", text.alias("fact"))


# ---------------------------------------------------------------- annotations


def annotation_merge(facts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Attach human notes (table, column, annotation) to facts; notes without a match are dropped."""
    return facts.join(annotations.select(*_KEY, "annotation"), _KEY, "left")


def validate_annotations(annotations: DataFrame, profile: DataFrame, max_length: int = ANNOTATION_LENGTH) -> DataFrame:
    """Warnings per note: unknown table or column, empty, too long, only repeating the name.

    A note on a whole table has a NULL column.
    """
    tables = profile.select("table").distinct().withColumn("_t", F.lit(True))
    columns = profile.select(*_KEY).distinct().withColumn("_c", F.lit(True))
    marked = annotations.join(tables, "table", "left").join(columns, _KEY, "left")
    note = F.col("annotation")
    spaced = F.regexp_replace(F.replace("column", F.lit("_"), F.lit(" ")), "([A-Z])", " $1")
    name_words = F.transform(F.filter(F.split(F.trim(spaced), r"\s+"), lambda w: F.length(w) > 0), lambda w: F.lower(w))
    words = F.filter(
        F.transform(
            F.split(F.lower(note), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", "")
        ),
        lambda w: F.length(w) > 2,
    )
    extra = F.array_except(F.array_except(words, name_words), F.array(*[F.lit(w) for w in FILLER_WORDS]))
    restated = (F.size(words) > 0) & (F.size(extra) == 0) & (F.size(name_words) > 0)
    known_column = F.col("column").isNull() | F.col("_c").isNotNull()
    blank = note.isNull() | (F.length(F.trim(note)) == 0)
    valid = F.col("_t").isNotNull() & known_column
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_t").isNull(), "unknown_table"),
            F.when(F.col("_t").isNotNull() & ~known_column, "unknown_column"),
            F.when(valid & blank, "empty"),
            F.when(valid & ~blank & (F.length(note) > max_length), "too_long"),
            F.when(valid & ~blank & F.col("column").isNotNull() & restated, "restates_name"),
        )
    )
    return marked.select(*_KEY, F.explode(warnings).alias("warning"))
