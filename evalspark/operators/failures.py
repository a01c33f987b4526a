"""Failure mining over recorded results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.keyed import top_n

# Words looked for in failed questions.
KEYWORDS = [
    "ratio",
    "percentage",
    "average",
    "count",
    "sum",
    "max",
    "min",
    "most",
    "least",
    "highest",
    "lowest",
    "difference",
    "between",
]
# Question classes in order of precedence, with the substrings that decide them.
QUESTION_CLASSES = [
    ("percentage_ratio_errors", ["percentage", "percent", "ratio"]),
    ("superlative_max_errors", ["highest", "most", "max"]),
    ("superlative_min_errors", ["lowest", "least", "min"]),
    ("average_errors", ["average", "avg"]),
    ("difference_errors", ["difference", "between"]),
    ("count_errors", ["count", "how many"]),
    ("sum_total_errors", ["sum", "total"]),
]


def outcome_bucket() -> Column:
    """correct, error, partial or wrong, in that precedence, from a result row's columns."""
    return (
        F.when(F.coalesce("is_correct", F.lit(False)), "correct")
        .when(F.length("error") > 0, "error")
        .when(F.length("partial_reason") > 0, "partial")
        .otherwise("wrong")
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    total = results.agg(F.count(F.lit(1))).scalar()
    counts = results.groupBy(outcome_bucket().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / total)


def partial_reasons(results: DataFrame, by_type: bool = False) -> DataFrame:
    """Partial results by full reason or by the reason's type before the colon."""
    reason = F.col("partial_reason")
    if by_type:
        reason = F.split_part(reason, F.lit(":"), F.lit(1))
    partial = results.filter(outcome_bucket() == "partial")
    return partial.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def error_type(message: Column) -> Column:
    return (
        F.when(message.contains("Binder Error"), "Binder Error")
        .when(message.contains("Catalog Error"), "Catalog Error")
        .when(message.contains("Parser Error"), "Parser Error")
        .when(F.lower(message).contains("timeout"), "Timeout")
        .otherwise("Other")
    )


def error_types(results: DataFrame, samples: int = 2, preview_chars: int | None = None) -> DataFrame:
    """Errors by type with their number and the first sample messages, cut to ``preview_chars`` if given."""
    errors = results.filter(outcome_bucket() == "error").withColumn("error_type", error_type(F.col("error")))
    counts = errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    shown = F.col("error") if preview_chars is None else F.substring("error", 1, preview_chars)
    preview = F.replace(shown, F.lit("\n"), F.lit(" "))
    first = top_n(
        errors.select("error_type", "question_id", "event_id", preview.alias("preview")),
        ["error_type"],
        [F.col("event_id")],
        samples,
        "sample",
    )
    return first.join(counts, "error_type").select("error_type", "n", "sample", "question_id", "preview")


def _case_shapes(cells: DataFrame) -> DataFrame:
    """Row count, width and first cell of both sides per case."""
    gold, pred = F.col("side") == "gold", F.col("side") == "pred"

    return cells.groupBy("case_id").agg(
        F.count_if(gold).alias("gold_rows"),
        F.count_if(pred).alias("pred_rows"),
        F.min(F.when(gold, F.struct("row_no", F.size("cells").alias("w"), F.col("cells")[0].alias("c")))).alias("_g"),
        F.min(F.when(pred, F.struct("row_no", F.size("cells").alias("w"), F.col("cells")[0].alias("c")))).alias("_p"),
    )


def shape_mismatch(cells: DataFrame, wrong_cases: DataFrame) -> DataFrame:
    """Wrong answers by column count, row count or value difference."""
    shapes = _case_shapes(cells).join(wrong_cases.select("case_id").distinct(), "case_id", "left_semi")
    both = shapes.filter((F.col("gold_rows") > 0) & (F.col("pred_rows") > 0))
    kind = (
        F.when(F.col("_g.w") != F.col("_p.w"), "column_count")
        .when(F.col("gold_rows") != F.col("pred_rows"), "row_count")
        .otherwise("value")
    )
    return both.groupBy(kind.alias("mismatch")).agg(F.count(F.lit(1)).alias("n"))


def cell_type(text: Column) -> Column:
    return (
        F.when(text.isNull(), "null")
        .when(text.rlike("^[+-]?[0-9]+$"), "int")
        .when(text.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "float")
        .otherwise("text")
    )


def cardinality_mismatch(cells: DataFrame) -> DataFrame:
    """List against single value, and different type of the first cell, per case."""
    shapes = _case_shapes(cells).filter((F.col("gold_rows") > 0) & (F.col("pred_rows") > 0))
    shape = F.when((F.col("gold_rows") > 1) & (F.col("pred_rows") == 1), "expected_list_got_single").when(
        (F.col("gold_rows") == 1) & (F.col("pred_rows") > 1), "expected_single_got_list"
    )
    return shapes.select(
        "case_id",
        shape.alias("cardinality"),
        (cell_type(F.col("_g.c")) != cell_type(F.col("_p.c"))).alias("type_mismatch"),
    )


def keyword_fail_rate(results: DataFrame, min_support: int = 5) -> DataFrame:
    """Wrong and correct answers per keyword in the question, where there are more than ``min_support``."""
    text = F.lower("question")
    words = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda w: F.contains(text, w))
    hits = results.select(F.explode(words).alias("keyword"), outcome_bucket().alias("outcome"))
    counts = hits.groupBy("keyword").agg(
        F.count_if(F.col("outcome") == "wrong").alias("wrong"),
        F.count_if(F.col("outcome") == "correct").alias("correct"),
    )
    seen = F.col("wrong") + F.col("correct")
    return counts.filter(seen > min_support).withColumn("fail_rate", F.col("wrong") * F.lit(100.0) / seen)


def question_category(question: Column) -> Column:
    """First class whose words occur in the question; plain substrings, also inside other words."""
    text = F.lower(question)
    chain = None
    for name, words in QUESTION_CLASSES:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("other_errors")


def question_categories(results: DataFrame) -> DataFrame:
    wrong = results.filter(outcome_bucket() == "wrong")
    return wrong.groupBy(question_category(F.col("question")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def top_failures_by_group(results: DataFrame, by: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` wrong answers of every group."""
    wrong = results.filter(outcome_bucket() == "wrong")
    return top_n(wrong.select(*by, "event_id", "question_id", "question"), by, [F.col("event_id")], n)
