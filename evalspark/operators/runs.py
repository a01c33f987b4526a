"""Run analytics over the ledger: summaries, timelines, histograms and the question matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.ledger import (
    COST_ACCOUNTS,
    DATASET_EPSILON,
    LATENCY_ACCOUNTS,
    UTILITY_ACCOUNTS,
    trial_balance,
)
from evalspark.plans.keyed import join_null_safe, latest_per_key
from evalspark.plans.sequence import previous_values


def recent_run_ids(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs by their newest event, newest first."""
    runs = events.groupBy("run_id").agg(F.max("event_time").alias("last_time"))
    ordered = runs.orderBy(F.desc("last_time"), F.asc_nulls_last("run_id"))
    return ordered if limit is None else ordered.limit(limit)


def latest_run_id(events: DataFrame) -> DataFrame:
    """The newest run; no row means there are no events, a NULL row the run without an id."""
    return recent_run_ids(events, 1)


def run_scope_filter(df: DataFrame, run_ids: list[str | None], col: str = "run_id") -> DataFrame:
    """Rows of the listed runs; a ``None`` in the list keeps the run without an id."""
    if not run_ids:
        return df
    named = [r for r in run_ids if r is not None]
    keep = F.col(col).isin(named) if named else F.lit(False)
    if len(named) < len(run_ids):
        keep = keep | F.col(col).isNull()
    return df.filter(keep)


def run_summary(
    events: DataFrame, postings: DataFrame, run_ids: list[str | None] | None = None, eps: float = DATASET_EPSILON
) -> DataFrame:
    """Per run: time range, event and kind counts, headline totals and the balance flag."""
    events = run_scope_filter(events, run_ids or [])
    heads = events.groupBy("run_id").agg(
        F.min("event_time").alias("first_time"),
        F.max("event_time").alias("last_time"),
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct("kind").alias("kind_count"),
        F.min("project_id").alias("project"),
    )
    delta = F.col("delta_numeric")
    # one side of the join is one narrow row per event; hot runs only matter after partial sums
    slices = (
        postings.join(events.select("event_id", "run_id"), "event_id")
        .groupBy("run_id", "account_type", "unit")
        .agg(F.sum(delta).alias("net"), F.sum(F.when(delta > 0, delta).otherwise(0.0)).alias("flow"))
    )

    def flow(accounts: list[str]) -> Column:
        return F.sum(F.when(F.col("account_type").isin(accounts), F.col("flow")))

    totals = slices.groupBy("run_id").agg(
        flow(COST_ACCOUNTS).alias("cost"),
        flow(LATENCY_ACCOUNTS).alias("latency_ms"),
        flow(UTILITY_ACCOUNTS).alias("utility"),
        F.bool_and(F.abs("net") <= eps).alias("invariant_ok"),
    )
    joined = join_null_safe(heads, totals, ["run_id"], "left")
    zero = F.lit(0.0)
    return joined.select(
        *heads.columns,
        F.coalesce("cost", zero).alias("cost"),
        F.coalesce("latency_ms", zero).alias("latency_ms"),
        F.coalesce("utility", zero).alias("utility"),
        F.coalesce("invariant_ok", F.lit(True)).alias("invariant_ok"),
    )


def events_for_run(events: DataFrame, run: str | None) -> DataFrame:
    """Timeline of one run in time order."""
    chosen = events.filter(F.col("run_id").eqNullSafe(F.lit(run).cast("string")))
    return chosen.select(
        "event_time", "event_id", "kind", "actor_agent_id", "actor_task_id", "idempotency_key", "payload_json"
    ).orderBy("event_time", "event_id")


def kind_counts(events: DataFrame, by_run: bool = False) -> DataFrame:
    """Histogram of event kinds, for the dataset or per run."""
    keys = ["run_id", "kind"] if by_run else ["kind"]
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def kind_counts_wide(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Run by kind counts with one column per kind, zero where a kind is absent."""
    wide = events.groupBy("run_id").pivot("kind", kinds).agg(F.count(F.lit(1)))
    return wide.select("run_id", *[F.coalesce(F.col(k), F.lit(0).cast("bigint")).alias(k) for k in kinds])


def has_kind(events: DataFrame, kind: str) -> DataFrame:
    """Per run: does it hold an event of this kind."""
    return events.groupBy("run_id").agg((F.count_if(F.col("kind") == kind) > 0).alias("present"))


# ---------------------------------------------------------------- run by question matrix


def eval_matrix(events: DataFrame, run_ids: list[str | None] | None = None) -> DataFrame:
    """Latest recorded correctness per run and question."""
    rows = run_scope_filter(events.filter(F.col("kind") == "evaluation_result"), run_ids or []).select(
        "run_id",
        F.get_json_object("payload_json", "$.question_id").alias("question_id"),
        "event_time",
        "event_id",
        F.get_json_object("payload_json", "$.is_correct").try_cast("boolean").alias("is_correct"),
    )
    last = latest_per_key(rows, ["run_id", "question_id"], ["event_time", "event_id"])
    return last.select("run_id", "question_id", "is_correct")


def matrix_transitions(matrix: DataFrame, runs: DataFrame) -> DataFrame:
    """Change of every cell against the same question's previous run in time order.

    ``runs`` has run_id and first_time. Runs that lack the question are skipped; an unknown
    correctness counts as wrong. A question's cells are cut into sort ranges, so one question
    that is in every run does not end up in one task.
    """
    cells = join_null_safe(
        matrix.withColumn("is_correct", F.coalesce("is_correct", F.lit(False))),
        runs.select("run_id", "first_time"),
        ["run_id"],
    )
    chained = previous_values(
        cells.withColumn("_run", F.coalesce("run_id", F.lit(""))),
        ["question_id"],
        ["first_time", "_run"],
        {"is_correct": "prev"},
    )
    changed = F.col("prev").isNotNull() & (F.col("prev") != F.col("is_correct"))
    kind = F.when(changed, F.when(F.col("is_correct"), "prog").otherwise("regr"))
    return chained.select("run_id", "question_id", "is_correct", "prev", kind.alias("kind"))


def matrix_volatility(transitions: DataFrame, cap: int | None = None) -> DataFrame:
    """Flips per question, most first, then numeric question ids before text ids; the first ``cap`` if given."""
    flips = transitions.groupBy("question_id").agg(F.count("kind").alias("flips"))
    number = F.when(F.col("question_id").rlike("^[0-9]+$"), F.col("question_id").try_cast("decimal(38,0)"))
    ordered = flips.orderBy(F.desc("flips"), number.asc_nulls_last(), F.col("question_id"))
    return ordered if cap is None else ordered.limit(cap)


def matrix_pivot(matrix: DataFrame, runs: list[str | None]) -> DataFrame:
    """One row per question with the cells of the given runs; absent cells stay NULL.

    The runs are the few shown side by side, so they become columns of one aggregate and no
    run by question product is built.
    """
    cells = [
        F.bool_or(
            F.when(F.col("run_id").eqNullSafe(F.lit(r).cast("string")), F.coalesce("is_correct", F.lit(False)))
        ).alias("none" if r is None else r.replace("-", "_"))
        for r in runs
    ]
    return matrix.groupBy("question_id").agg(*cells)


# ---------------------------------------------------------------- trends and totals


def trend_series(summary: DataFrame) -> DataFrame:
    """Cost, latency and utility per run in time order within a project, with the change."""
    measures = ["cost", "latency_ms", "utility"]
    rows = summary.select("project", "run_id", "first_time", *measures).withColumn(
        "_run", F.coalesce("run_id", F.lit(""))
    )
    chained = previous_values(
        rows,
        ["project"],
        ["first_time", "_run"],
        {m: f"{m}_before" for m in measures},
    )
    return chained.select(
        "project",
        "run_id",
        "first_time",
        *measures,
        *[(F.col(m) - F.col(f"{m}_before")).alias(f"{m}_delta") for m in measures],
    )


def dashboard_totals(summary: DataFrame, postings: DataFrame, eps: float = DATASET_EPSILON) -> DataFrame:
    """Runs, events, cost, utility and the number of unbalanced slices in one row."""
    bad = trial_balance(postings, eps=eps).agg(F.count(F.lit(1))).scalar()
    return summary.agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("event_count").alias("events"),
        F.sum("cost").alias("cost"),
        F.sum("utility").alias("utility"),
    ).withColumn("violations", bad)
