"""Analytics over recorded evaluation runs: scoring, leaderboards, lift, splits and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.keyed import join_null_safe, latest_per_key, top_n
from evalspark.plans.sequence import exact_medians, rank_rows

# Partial matches that earn the point.
ACCEPTED_PARTIALS = ["extra_columns", "extra_duplicates", "implicit_distinct", "aggregated_equivalent"]
RESOLVED_PARTIALS = ["extra_duplicates", "implicit_distinct", "aggregated_equivalent"]
CATEGORIES = [
    "correct_gold",
    "correct_platinum",
    "correct_judge",
    "partial_accepted",
    "partial_unaccepted",
    "incorrect",
    "error",
    "hit_limit",
]
# Display order of the correctness levels.
LEVEL_ORDER = {"error": 0, "hit_limit": 1, "incorrect": 2, "partial": 3, "correct": 4, "judge_correct": 4}
CONFIGS = ["baseline", "comments", "full"]


def _n() -> Column:
    return F.count(F.lit(1))


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


# ---------------------------------------------------------------- puzzle runs


def completed_runs(summaries: DataFrame, order: list[str]) -> DataFrame:
    """Latest summary per run, kept only when its status is completed or missing."""
    last = latest_per_key(summaries, ["run_id"], order)
    return last.filter(F.coalesce("status", F.lit("completed")) == "completed")


def completed_exchanges(exchanges: DataFrame, completed: DataFrame) -> DataFrame:
    return exchanges.join(completed.select("run_id").distinct(), "run_id", "left_semi")


def model_leaderboard(completed: DataFrame) -> DataFrame:
    """Per model: runs, solved, attempted, rate, median cost per puzzle and median time."""
    counts = completed.groupBy("model").agg(
        _n().alias("runs"), F.sum("puzzles_solved").alias("solved"), F.sum("puzzles_attempted").alias("attempted")
    )
    medians = exact_medians(
        completed,
        ["model"],
        {
            "med_cost_per_puzzle": F.try_divide(F.col("total_cost"), F.col("puzzles_attempted")),
            "med_time": F.col("avg_time_sec"),
        },
    )
    return join_null_safe(counts, medians, ["model"], "left").select(
        "model",
        "runs",
        "solved",
        "attempted",
        F.round(_pct(F.col("solved"), F.col("attempted")), 1).alias("solve_pct"),
        F.round("med_cost_per_puzzle", 4).alias("med_cost_per_puzzle"),
        F.round("med_time", 1).alias("med_time"),
    )


def run_leaderboard(completed: DataFrame) -> DataFrame:
    """Per run: rate, cost per puzzle, tokens and time as numbers that sort correctly."""
    return completed.select(
        "run_id",
        "model",
        "puzzles_solved",
        "puzzles_attempted",
        F.round(_pct(F.col("puzzles_solved"), F.col("puzzles_attempted")), 1).alias("solve_pct"),
        F.round("total_cost", 4).alias("cost"),
        F.round(F.try_divide("total_cost", "puzzles_attempted"), 4).alias("cost_per_puzzle"),
        F.col("total_tokens").alias("tokens"),
        F.round("avg_time_sec", 1).alias("avg_time"),
    )


def item_difficulty(exchanges: DataFrame) -> DataFrame:
    """Two levels: per puzzle, model and run, then per puzzle. "Won" needs the exact final result."""
    result = F.col("result")
    per_run = exchanges.groupBy("puzzle_id", "model", "run_id").agg(
        F.count_if(result.startswith("CORRECT")).alias("correct"),
        F.count_if(result.startswith("INCORRECT")).alias("incorrect"),
        F.max(F.when(result == "CORRECT", 1).otherwise(0)).alias("won"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
        F.sum("latency_ms").alias("ms"),
        F.max("guess_index").alias("guesses"),
    )
    counts = per_run.groupBy("puzzle_id").agg(
        _n().alias("runs"), F.sum("won").alias("wins"), F.round(F.avg("guesses"), 1).alias("avg_guesses")
    )
    medians = exact_medians(
        per_run,
        ["puzzle_id"],
        {
            "med_correct": F.col("correct"),
            "med_incorrect": F.col("incorrect"),
            "med_cost": F.round("cost", 9),
            "med_ms": F.col("ms"),
        },
    )
    return join_null_safe(counts, medians, ["puzzle_id"], "left").select(
        "puzzle_id",
        "runs",
        "wins",
        F.round(_pct(F.col("wins"), F.col("runs")), 0).alias("solve_pct"),
        "avg_guesses",
        F.round("med_correct", 1).alias("med_correct"),
        F.round("med_incorrect", 1).alias("med_incorrect"),
        F.round("med_cost", 4).alias("med_cost"),
        F.round(F.col("med_ms") / 1000, 1).alias("med_time_sec"),
    )


def cost_analysis(exchanges: DataFrame) -> DataFrame:
    """Per model: total cost and medians per puzzle of cost, tokens and latency."""
    zero = F.lit(0)
    per_item = exchanges.groupBy("model", "run_id", "puzzle_id").agg(
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"),
        F.sum(F.coalesce("prompt_tokens", zero)).alias("prompt"),
        F.sum(F.coalesce("completion_tokens", zero)).alias("completion"),
        F.sum("latency_ms").alias("ms"),
    )
    totals = per_item.groupBy("model").agg(F.round(F.sum("cost"), 4).alias("total_cost"))
    medians = exact_medians(
        per_item,
        ["model"],
        {
            "med_cost_per_puzzle": F.round("cost", 9),
            "med_prompt_tok": F.col("prompt"),
            "med_compl_tok": F.col("completion"),
            "med_latency_ms": F.col("ms"),
        },
    )
    return join_null_safe(totals, medians, ["model"], "left").select(
        "model",
        "total_cost",
        F.round("med_cost_per_puzzle", 4).alias("med_cost_per_puzzle"),
        F.round("med_prompt_tok", 0).alias("med_prompt_tok"),
        F.round("med_compl_tok", 0).alias("med_compl_tok"),
        F.round("med_latency_ms", 0).alias("med_latency_ms"),
    )


def cost_by_run(exchanges: DataFrame) -> DataFrame:
    cost = F.sum(F.coalesce("cost", F.lit(0.0)))
    return exchanges.groupBy("model", "run_id").agg(
        F.round(cost, 4).alias("total_cost"),
        (cost / F.count_distinct("puzzle_id")).alias("cost_per_puzzle"),
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tok"),
        F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tok"),
        F.round(F.avg("latency_ms"), 0).alias("avg_latency"),
    )


def replay(exchanges: DataFrame, completed: DataFrame, last_runs: int | None = None, page: int | None = None) -> DataFrame:
    """Ordered attempts of the last runs with the outcome of their puzzle."""
    runs = completed.select("run_id").distinct()
    if last_runs is not None:
        runs = runs.orderBy(F.desc("run_id")).limit(last_runs)
    chosen = exchanges.join(runs, "run_id", "left_semi")
    outcome = chosen.groupBy("run_id", "puzzle_id").agg(
        F.bool_or(F.col("result") == "CORRECT").alias("won"),
        F.count_if(F.col("result").startswith("CORRECT")).alias("_solved"),
    )
    rows = chosen.join(outcome, ["run_id", "puzzle_id"]).select(
        "run_id",
        "puzzle_id",
        "guess_index",
        "guess",
        "result",
        "latency_ms",
        F.round(F.coalesce("cost", F.lit(0.0)), 4).alias("cost"),
        "won",
        (F.col("won") & (F.col("_solved") < 4)).alias("auto_solved"),
    )
    ordered = rows.orderBy(F.desc("run_id"), "puzzle_id", "guess_index")
    return ordered if page is None else ordered.limit(page)


def run_totals(exchanges: DataFrame) -> DataFrame:
    """Summary of a run from its attempts: puzzles first, then the run."""
    result = F.col("result")
    per_puzzle = exchanges.groupBy("run_id", "model", "puzzle_id").agg(
        F.max(F.when(result == "CORRECT", 1).otherwise(0)).alias("won"),
        _n().alias("turns"),
        F.count_if(result.startswith("INVALID")).alias("invalid"),
        F.count_if(result.startswith("INCORRECT")).alias("mistakes"),
        F.sum("latency_ms").alias("ms"),
        F.sum("prompt_tokens").alias("prompt"),
        F.sum("completion_tokens").alias("completion"),
        F.sum("cost").alias("cost"),
    )
    zero = F.lit(0)
    return per_puzzle.groupBy("run_id", "model").agg(
        _n().alias("puzzles_attempted"),
        F.sum("won").alias("puzzles_solved"),
        F.sum(F.col("turns") - F.col("invalid")).alias("total_guesses"),
        F.sum(F.col("turns") - F.col("invalid") - F.col("mistakes")).alias("correct_guesses"),
        F.sum("mistakes").alias("incorrect_guesses"),
        F.sum("invalid").alias("invalid_responses"),
        F.round(F.sum("ms") / 1000, 1).alias("total_time_sec"),
        F.coalesce(F.sum("prompt"), zero).alias("total_prompt_tokens"),
        F.coalesce(F.sum("completion"), zero).alias("total_completion_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
    )


# ---------------------------------------------------------------- scoring


def _accepted(reason: Column) -> Column:
    return F.coalesce(reason.rlike("^(" + "|".join(ACCEPTED_PARTIALS) + ")"), F.lit(False))


def score_category(level: Column, reason: Column, source: Column) -> Column:
    return (
        F.when((level == "correct") & source.eqNullSafe(F.lit("platinum")), "correct_platinum")
        .when(level == "correct", "correct_gold")
        .when(level == "judge_correct", "correct_judge")
        .when(level == "error", "error")
        .when(level == "hit_limit", "hit_limit")
        .when((level == "partial") & _accepted(reason), "partial_accepted")
        .when(level == "partial", "partial_unaccepted")
        .otherwise("incorrect")
    )


def score_result(results: DataFrame) -> DataFrame:
    """Add score category and score; credited are correct, judged and accepted partial results."""
    category = score_category(F.col("level"), F.col("partial_reason"), F.col("match_source"))
    credited = F.col("category").isin(CATEGORIES[:4])
    return results.withColumn("category", category).withColumn("score", F.when(credited, 1.0).otherwise(0.0))


def _category_counts() -> list[Column]:
    return [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]


def accuracy_stats(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts per score category, credited results and accuracy per group."""
    return (
        score_result(results)
        .groupBy(*by)
        .agg(_n().alias("total"), *_category_counts(), F.sum("score").cast("bigint").alias("credited"))
        .withColumn("accuracy", F.col("credited") / F.col("total"))
    )


def needs_judge(results: DataFrame) -> DataFrame:
    """Results that neither reference nor the accepted partial rules have settled."""
    level = F.col("level")
    settled = (
        level.isin("correct", "hit_limit", "error")
        | F.coalesce(F.col("match_source").isin("gold", "platinum"), F.lit(False))
        | ((level == "partial") & _accepted(F.col("partial_reason")))
    )
    return results.filter(~settled)


# ---------------------------------------------------------------- run reports


def model_config_summary(results: DataFrame) -> DataFrame:
    """Counts by score category and cost per model and configuration, with one total row."""
    scored = score_result(results)
    cells = scored.groupBy("model", "config").agg(
        _n().alias("total"), *_category_counts(), F.sum("cost").alias("cost")
    )
    sums = [F.sum(c).alias(c) for c in ["total", *CATEGORIES, "cost"]]
    return (
        cells.groupingSets([[F.col("model"), F.col("config")], []], "model", "config")
        .agg(*sums, F.grouping("model").cast("int").alias("is_total"))
        .withColumn("model", F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("model")))
    )


def accuracy_by(results: DataFrame, dimensions: list[str]) -> DataFrame:
    """Outcome counts for each dimension on its own, lowest accuracy first within one."""
    from evalspark.operators.failures import outcome_bucket

    bucketed = results.withColumn("outcome", outcome_bucket())
    pairs = F.array(*[F.struct(F.lit(d).alias("d"), F.col(d).cast("string").alias("v")) for d in dimensions])
    long = bucketed.withColumn("p", F.explode(pairs))
    counts = long.groupBy(F.col("p.d").alias("dimension"), F.coalesce("p.v", F.lit("unknown")).alias("value")).agg(
        _n().alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("correct", "wrong", "partial", "error")],
    )
    return counts.withColumn("accuracy_pct", _pct(F.col("correct"), F.col("total"))).orderBy(
        "dimension", "accuracy_pct", "value"
    )


def train_test_table(results: DataFrame) -> DataFrame:
    """Model by configuration with train and test side by side; absent cells are zero."""
    scored = score_result(results)
    aggregates = [
        x
        for phase in ("train", "test")
        for x in (
            F.count_if(F.col("phase") == phase).alias(f"{phase}_total"),
            F.count_if((F.col("phase") == phase) & (F.col("score") > 0)).alias(f"{phase}_correct"),
        )
    ]
    cells = scored.groupBy("model", "config").agg(*aggregates)
    grid = scored.select("model").distinct().withColumn("config", F.explode(F.array(*[F.lit(c) for c in CONFIGS])))
    full = grid.join(cells, ["model", "config"], "left").fillna(0)
    for phase in ("train", "test"):
        rate = F.coalesce(F.try_divide(F.col(f"{phase}_correct"), F.col(f"{phase}_total")), F.lit(0.0))
        full = full.withColumn(f"{phase}_accuracy", rate)
    return full


def lift_analysis(results: DataFrame) -> DataFrame:
    """Test accuracy of the three configurations per model and the gains between them."""
    tests = score_result(results.filter(F.col("phase") == "test"))
    acc = tests.groupBy("model").agg(
        *[F.avg(F.when(F.col("config") == c, F.col("score"))).alias(c) for c in CONFIGS]
    )
    full = acc.filter(F.col("baseline").isNotNull() & F.col("comments").isNotNull() & F.col("full").isNotNull())
    return full.select(
        "model",
        *CONFIGS,
        (F.col("comments") - F.col("baseline")).alias("comments_lift"),
        (F.col("full") - F.col("baseline")).alias("full_lift"),
        (F.col("full") - F.col("comments")).alias("history_lift"),
    )


def arm_compare(results: DataFrame, left: str, right: str) -> DataFrame:
    """Two arms in one row: correct, n, percentage, cost and the difference in points."""

    def side(arm: str) -> list[Column]:
        mine = F.col("config") == arm
        return [
            F.count_if(mine & F.col("is_correct")).alias(f"{arm}_correct"),
            F.count_if(mine).alias(f"{arm}_n"),
            F.sum(F.when(mine, F.coalesce("cost", F.lit(0.0)))).alias(f"{arm}_cost"),
        ]

    row = results.agg(*side(left), *side(right))
    for arm in (left, right):
        row = row.withColumn(f"{arm}_pct", F.coalesce(_pct(F.col(f"{arm}_correct"), F.col(f"{arm}_n")), F.lit(0.0)))
    return row.withColumn("delta_points", F.col(f"{right}_pct") - F.col(f"{left}_pct"))


def arm_trace_compare(results: DataFrame, left: str, right: str) -> DataFrame:
    """Both arms of a question side by side; a question of one arm only keeps NULLs."""
    both = results.filter(F.col("config").isin(left, right))
    last = latest_per_key(
        both.select("question_id", "model", "config", "event_time", "event_id", "level", "turns"),
        ["question_id", "model", "config"],
        ["event_time", "event_id"],
    )
    cells = [
        F.max(F.when(F.col("config") == arm, F.col(c))).alias(f"{arm}_{c}")
        for arm in (left, right)
        for c in ("level", "turns")
    ]
    return last.groupBy("question_id", "model").agg(*cells)


def results_summary(results: DataFrame) -> DataFrame:
    """Headline numbers, counts by correctness and by level as (section, key, n, correct, value)."""
    zero = F.lit(0.0)
    head = results.agg(
        _n().alias("n"),
        F.count_if("is_correct").alias("correct"),
        F.sum(F.coalesce("cost", zero)).alias("cost"),
        (F.sum("duration_ms") / 1000).alias("time_sec"),
        F.avg("turns").alias("avg_turns"),
        F.count_if(F.col("level") == "hit_limit").cast("double").alias("hit_limit"),
    )
    values = ["cost", "time_sec", "avg_turns", "hit_limit"]
    top = head.select(
        "n", "correct", F.explode(F.array(*[F.struct(F.lit(v).alias("key"), F.col(v).alias("value")) for v in values])).alias("p")
    ).select(F.lit("total").alias("section"), "p.key", "n", "correct", "p.value")

    def section(name: str, key: str) -> DataFrame:
        grouped = results.groupBy(F.coalesce(key, F.lit("?")).alias("key")).agg(
            _n().alias("n"), F.count_if("is_correct").alias("correct")
        )
        return grouped.select(F.lit(name).alias("section"), "key", "n", "correct", _pct(F.col("correct"), F.col("n")).alias("value"))

    return top.unionByName(section("correctness", "level")).unionByName(section("difficulty", "difficulty"))


def question_stability(results: DataFrame, by: list[str]) -> DataFrame:
    """Always right, always wrong or flaky over repetitions, with the share of right answers."""
    right = F.coalesce("is_correct", F.lit(False))
    grouped = results.groupBy(*by).agg(
        _n().alias("repetitions"), F.count_if(right).alias("right")
    )
    kind = (
        F.when(F.col("right") == F.col("repetitions"), "always_right")
        .when(F.col("right") == 0, "always_wrong")
        .otherwise("flaky")
    )
    return grouped.withColumn("stability", kind).withColumn("right_share", F.col("right") / F.col("repetitions"))


def rep_variance(results: DataFrame) -> DataFrame:
    """Per configuration: number of runs, mean and deviation of their correct counts, mean cost."""
    per_run = results.groupBy("config", "run_id").agg(
        F.count_if("is_correct").alias("correct"), F.sum("cost").alias("cost")
    )
    return per_run.groupBy("config").agg(
        _n().alias("runs"),
        F.avg("correct").alias("mean_correct"),
        F.stddev("correct").alias("stdev_correct"),
        F.min("correct").alias("min_correct"),
        F.max("correct").alias("max_correct"),
        F.avg("cost").alias("mean_cost"),
    )


# ---------------------------------------------------------------- splits and samples


def stratified_split(
    questions: DataFrame, key: str, stratum: str, ratio: float = 0.3, seed: str = "42"
) -> DataFrame:
    """Reproducible split: the first ``round(n * ratio)`` ids of each stratum in hash order.

    At least one and, with more than one id, at most ``n - 1`` go to train. The rank of an id
    comes from running counts over sort ranges, so a large stratum is spread over many tasks.
    """
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")).cast("binary"))
    rows = questions.select(key, F.coalesce(F.col(stratum), F.lit("unknown")).alias(stratum)).distinct()
    rows = rows.withColumn("_digest", digest)
    ranked = rank_rows(rows, [stratum], ["_digest", key], "_rank")
    sizes = rows.groupBy(stratum).agg(_n().alias("_n"))
    wanted = F.greatest(F.bround(F.col("_n") * F.lit(float(ratio)), 0), F.lit(1.0))
    take = F.when(F.col("_n") > 1, F.least(wanted, (F.col("_n") - 1).cast("double"))).otherwise(wanted)
    joined = ranked.join(sizes, stratum)
    split = F.when(F.col("_rank") <= take, "train").otherwise("test")
    return joined.select(key, stratum, split.alias("split"))


def split_distribution(split: DataFrame, stratum: str) -> DataFrame:
    """Counts per stratum and split, and the total per split."""
    cells = split.groupBy(stratum).agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test")
    )
    return (
        cells.rollup(stratum)
        .agg(F.sum("train").alias("train"), F.sum("test").alias("test"), F.grouping(stratum).alias("_g"))
        .select(
            F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(stratum)).alias(stratum),
            "train",
            "test",
            (F.col("train") + F.col("test")).alias("total"),
        )
    )


def round_robin_sample(questions: DataFrame, key: str, stratum: str, k: int) -> DataFrame:
    """``k`` rows, one per stratum in turn, lowest keys first."""
    firsts = top_n(questions.select(key, stratum).distinct(), [stratum], [F.col(key)], k, "turn")
    return firsts.orderBy("turn", stratum).limit(k)


def filter_by_difficulty(questions: DataFrame, difficulty: str, by: str = "db_id") -> DataFrame:
    return questions.filter(F.col("difficulty") == difficulty).groupBy(by).agg(_n().alias("n"))


def anti_split(questions: DataFrame, ids: DataFrame, key: str, keep_listed: bool = False) -> DataFrame:
    """Rows whose id is not (or is) in the list."""
    return questions.join(ids.select(key).distinct(), key, "left_semi" if keep_listed else "left_anti")


# ---------------------------------------------------------------- cards and reviews


CARD_SCHEMA = (
    "question_id string, db_id string, question_text string, model string, config_type string, "
    "correctness_level string, is_correct string, match_source string, partial_reason string, "
    "tool_calls string, duration_ms string, cost_usd string"
)


def error_cards(events: DataFrame) -> DataFrame:
    """Typed evaluation rows from JSON payloads; malformed numbers fall back, errors come first."""
    typed = events.filter(F.col("kind") == "evaluation_result").select(
        "run_id", "event_time", F.from_json("payload_json", CARD_SCHEMA).alias("p")
    )
    level = F.coalesce("p.correctness_level", F.lit("incorrect"))
    rank = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for pair in LEVEL_ORDER.items() for x in pair]), level), F.lit(3)
    )
    right = F.coalesce(F.col("p.is_correct").try_cast("boolean"), F.lit(False))
    return typed.select(
        "run_id",
        F.coalesce("p.question_id", F.lit("")).alias("question_id"),
        F.coalesce("p.db_id", F.lit("")).alias("db_id"),
        F.coalesce("p.model", F.lit("")).alias("model"),
        level.alias("correctness_level"),
        rank.alias("level_rank"),
        right.alias("is_correct"),
        F.when(right, 1.0).otherwise(0.0).alias("score"),
        F.coalesce(F.col("p.tool_calls").try_cast("int"), F.lit(0)).alias("tool_calls"),
        F.coalesce(F.col("p.duration_ms").try_cast("double"), F.lit(0.0)).alias("duration_ms"),
        F.col("p.cost_usd").try_cast("double").alias("cost_usd"),
    ).orderBy("level_rank", "question_id")


def level_counts(results: DataFrame, by: list[str]) -> DataFrame:
    """Counts per correctness level, accepted and other partial results, and second-reference matches."""
    level = F.col("level")
    return results.groupBy(*by).agg(
        _n().alias("total"),
        F.count_if(level.isin("correct", "judge_correct")).alias("correct"),
        F.count_if(level == "error").alias("error"),
        F.count_if(level == "hit_limit").alias("hit_limit"),
        F.count_if(level == "incorrect").alias("incorrect"),
        F.count_if(level == "partial").alias("partial"),
        F.count_if((level == "partial") & _accepted(F.col("partial_reason"))).alias("partial_accepted"),
        F.count_if(F.col("match_source") == "platinum").alias("platinum"),
    )


def attach_investigations(results: DataFrame, investigations: DataFrame, judgements: DataFrame) -> DataFrame:
    """Add the last investigation per (run, question, model) and judgement per (run, question)."""
    keys = ["run_id", "question_id", "model"]
    found = latest_per_key(
        investigations.select(*keys, "event_time", "event_id", "category", "verdict"), keys, ["event_time", "event_id"]
    ).select(*keys, F.col("category").alias("error_category"), "verdict")
    judged = latest_per_key(
        judgements.select(*keys[:2], "event_time", "event_id", "judged_correct"), keys[:2], ["event_time", "event_id"]
    ).select(*keys[:2], "judged_correct")
    return join_null_safe(join_null_safe(results, found, keys, "left"), judged, keys[:2], "left")


def run_start_times(results: DataFrame) -> DataFrame:
    """Earliest event per run and the configuration letter, from the column, or the database name or exchange id."""
    database = F.lower(F.concat_ws(" ", *[c for c in ("exchange_id", "database") if c in results.columns]))
    letter = (
        F.when(F.length("config") > 0, F.upper(F.substring("config", 1, 1)))
        .when(database.contains("bench_a"), "A")
        .when(database.contains("bench_b"), "B")
        .when(database.contains("bench_c"), "C")
    )
    return results.filter(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.min("event_time").alias("first_time"), F.min(letter).alias("config_label")
    )


def review_queue(
    results: DataFrame, reviewed: DataFrame, second_reference: DataFrame, run: str | None = None
) -> DataFrame:
    """Why each result is skipped in the review, or NULL when it has to be looked at.

    ``run`` is a run id prefix, or ``latest`` for the run with the newest event.
    """
    in_run = F.lit(True)
    if run == "latest":
        newest = results.filter(F.col("run_id").isNotNull()).agg(F.max_by("run_id", F.struct("event_time", "run_id"))).scalar()
        in_run = F.coalesce(F.col("run_id").startswith(newest), F.lit(False))
    elif run is not None:
        in_run = F.coalesce(F.col("run_id").startswith(run), F.lit(False))
    marked = results.join(
        reviewed.select("question_id").distinct().withColumn("_reviewed", F.lit(True)), "question_id", "left"
    ).join(second_reference.select("question_id").distinct().withColumn("_second", F.lit(True)), "question_id", "left")
    correct = F.col("level") == "correct"
    second_match = correct & F.col("match_source").eqNullSafe(F.lit("platinum"))
    resolved = F.coalesce(F.col("partial_reason").rlike("|".join(RESOLVED_PARTIALS)), F.lit(False))
    reason = (
        F.when(~in_run, "wrong_run")
        .when(F.col("_reviewed"), "already_reviewed")
        .when(second_match, "correct_platinum")
        .when(correct, "correct_gold")
        .when((F.col("level") == "partial") & resolved, "resolved_partial")
    )
    status = F.when(
        F.col("_second"),
        F.when(second_match, "PLATINUM_MATCH").when(correct, "GOLD_MATCH").otherwise("NOT_MATCHING"),
    )
    return marked.withColumn("skip_reason", reason).withColumn("reference_status", status).drop("_reviewed", "_second")


def review_queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy(F.coalesce("skip_reason", F.lit("queued")).alias("reason")).agg(_n().alias("n"))


def verdict_summary(reviews: DataFrame) -> DataFrame:
    """Share of every verdict and recommendation, and the confident ones for the second reference."""
    total = reviews.agg(_n()).scalar()

    def part(kind: str, column: str, rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col(column).alias("value")).agg(_n().alias("n")).select(F.lit(kind).alias("kind"), "value", "n")

    sure = reviews.filter((F.col("verdict") == "PREDICTED_CORRECT") & (F.col("confidence") == "HIGH"))
    parts = part("verdict", "verdict", reviews).unionByName(part("recommendation", "recommendation", reviews))
    return parts.unionByName(part("high_confidence", "verdict", sure)).withColumn("pct", _pct(F.col("n"), total))


def merge_review(accepted: DataFrame, reviews: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Append reviewed entries whose id is not yet in the accepted set."""
    fresh = latest_per_key(reviews.select(*accepted.columns, *[o for o in order if o not in accepted.columns]), [key], order)
    added = fresh.join(accepted.select(key).distinct(), key, "left_anti").select(*accepted.columns)
    return accepted.withColumn("is_new", F.lit(False)).unionByName(added.withColumn("is_new", F.lit(True)))


def introspection_summary(investigations: DataFrame) -> DataFrame:
    """Investigations by category for the newest run."""
    newest = investigations.agg(F.max_by("run_id", F.struct("event_time", "run_id"))).scalar()
    return investigations.filter(F.col("run_id") == newest).groupBy("run_id", "category").agg(
        _n().alias("n"), F.count_distinct("question_id").alias("questions")
    )
