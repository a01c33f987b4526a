"""Double-entry event ledger: ingest, postings, balance and completeness checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.ids import deterministic_event_id, deterministic_posting_id, text_hash
from evalspark.plans.keyed import add_missing, join_null_safe, latest_per_key, spread
from evalspark.plans.sequence import previous_values

EVENT_EPSILON = 1e-9
DATASET_EPSILON = 1e-4
# Account types behind the headline totals, current and legacy names.
COST_ACCOUNTS = ["truth.money", "resource.money"]
LATENCY_ACCOUNTS = ["truth.time", "resource.time_ms"]
UTILITY_ACCOUNTS = ["truth.utility", "value.utility"]

ALL_RUNS = object()


# ---------------------------------------------------------------- ids and ingest


def dedupe_latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per id, the newest by ``order``; rows without an id are dropped."""
    return latest_per_key(spread(df.filter(F.col(key).isNotNull()), [key]), [key], order)


def ingest_idempotent(
    incoming: DataFrame, target: DataFrame, key: str, order: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows whose id the target lacks, and one row of counts (received, distinct, inserted)."""
    unique = dedupe_latest(incoming, key, order)
    fresh = add_missing(unique, target, [key])
    counts = incoming.agg(
        F.count(F.lit(1)).alias("received"), F.count_distinct(key).alias("distinct_ids")
    ).withColumn("inserted", fresh.agg(F.count(F.lit(1))).scalar())
    return fresh, counts


def missing_ids(local: DataFrame, remote: DataFrame, key: str, sample: int = 5) -> tuple[DataFrame, DataFrame]:
    """Ids present locally but not remotely, and their number with the first few values."""
    lost = add_missing(local.select(key).filter(F.col(key).isNotNull()).distinct(), remote, [key])
    first = lost.orderBy(key).limit(sample).agg(F.array_join(F.array_sort(F.collect_list(key)), ",")).scalar()
    summary = lost.agg(F.count(F.lit(1)).alias("missing")).withColumn("sample", first)
    return lost, summary


def with_event_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("event_id", deterministic_event_id(F.col("project_id"), F.col("idempotency_key")))


def with_posting_ids(events: DataFrame, postings: str = "postings") -> DataFrame:
    """One row per element of the postings array, with the id that belongs to its position."""
    rows = events.select("event_id", F.posexplode(postings).alias("position", "p"))
    return rows.select(
        deterministic_posting_id(F.col("event_id"), F.col("position")).alias("posting_id"),
        "event_id",
        "position",
        "p.*",
    )


def merge_default_dims(dims: Column, defaults: dict[str, str]) -> Column:
    """Defaults overlaid by a row's own map entries (session setting: last entry wins)."""
    pairs = [x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))]
    empty = F.create_map().cast("map<string,string>")
    return F.map_concat(F.create_map(*pairs), F.coalesce(dims, empty))


# ---------------------------------------------------------------- building postings


def _leg(account_type: str, account: Column, unit: str, delta: Column, dims: Column) -> Column:
    return F.struct(
        F.lit(account_type).alias("account_type"),
        account.alias("account_id"),
        F.lit(unit).alias("unit"),
        delta.cast("double").alias("delta_numeric"),
        F.to_json(dims).alias("dims_json"),
    )


def _pair(account_type: str, giver: Column, taker: Column, unit: str, amount: Column, dims: Column) -> list[Column]:
    """Two legs that move ``amount`` from one account to the other."""
    return [
        _leg(account_type, giver, unit, -amount.cast("double"), dims),
        _leg(account_type, taker, unit, amount.cast("double"), dims),
    ]


def _legs(df: DataFrame, key: Column, kind: str, legs: list[Column]) -> DataFrame:
    built = df.select(
        key.alias("idempotency_key"), F.lit(kind).alias("kind"), F.filter(F.array(*legs), lambda x: x["delta_numeric"].isNotNull()).alias("legs")
    )
    return built.select("idempotency_key", "kind", F.posexplode("legs").alias("leg", "p")).select(
        "idempotency_key", "kind", "leg", "p.*"
    )


def _account(role: str, name: str) -> Column:
    return F.concat(F.lit(f"{role}:"), F.col(name))


def build_postings_model_call(calls: DataFrame) -> DataFrame:
    """Legs of a prompt and a completion event per call; money only where a cost is known.

    Input columns: exchange_id, project_id, provider, agent_id, model, prompt_tokens,
    completion_tokens, wall_ms, cost_money.
    """
    provider, project = _account("provider", "provider"), _account("project", "project_id")

    def dims(phase: str) -> Column:
        return F.struct(F.col("model"), F.lit(phase).alias("phase"))

    prompt = _pair("resource.tokens", provider, project, "+tokens", F.col("prompt_tokens"), dims("prompt"))
    done = (
        _pair("resource.tokens", provider, project, "+tokens", F.col("completion_tokens"), dims("completion"))
        + _pair("truth.time", _account("agent", "agent_id"), project, "ms", F.col("wall_ms"), F.struct(F.lit("wall").alias("kind")))
        + _pair("truth.money", _account("vendor", "provider"), project, "$", F.col("cost_money"), F.struct(F.col("model")))
    )
    first = _legs(calls, F.concat(F.col("exchange_id"), F.lit(":prompt")), "model_prompt", prompt)
    second = _legs(calls, F.concat(F.col("exchange_id"), F.lit(":completion")), "model_completion", done)
    return first.unionByName(second)


def build_postings_state_move(moves: DataFrame) -> DataFrame:
    """One task leaves a state and enters another. Columns: task_id, from_state, to_state, move_key."""
    task = _account("task", "task_id")
    legs = [
        _leg("truth.state", task, "tasks", F.lit(-1.0), F.struct(F.col("from_state").alias("from"))),
        _leg("truth.state", task, "tasks", F.lit(1.0), F.struct(F.col("to_state").alias("to"))),
    ]
    default = F.concat_ws(":", "task_id", "from_state", "to_state")
    return _legs(moves, F.coalesce(F.col("move_key"), default), "state_move", legs)


def build_postings_utility(scores: DataFrame) -> DataFrame:
    """Points a task earns from its project. Columns: event_key, task_id, project_id, metric, score."""
    legs = _pair(
        "truth.utility",
        _account("project", "project_id"),
        _account("task", "task_id"),
        "points",
        F.col("score"),
        F.struct(F.col("metric")),
    )
    return _legs(scores, F.col("event_key"), "utility", [legs[1], legs[0]])


def build_postings_task_complete(tasks: DataFrame) -> DataFrame:
    """Ten legs over five accounts for a finished task.

    Columns: run_id, task_id, project_id, provider, agent_id, model, total_tokens, wall_ms, cost,
    is_correct, finished.
    """
    project, task = _account("project", "project_id"), _account("task", "task_id")
    model = F.struct(F.col("model"))
    final = F.when(F.col("finished"), "DONE").otherwise("FAILED")
    reward = F.when(F.col("is_correct"), 1.0).otherwise(0.0)
    gain = _pair("truth.utility", project, task, "points", reward, F.struct(F.lit("reward").alias("metric")))
    legs = (
        _pair("resource.tokens", _account("provider", "provider"), project, "+tokens", F.col("total_tokens"), model)
        + _pair("truth.time", _account("agent", "agent_id"), project, "ms", F.col("wall_ms"), F.struct(F.lit("wall").alias("kind")))
        + _pair("truth.money", _account("vendor", "provider"), project, "$", F.coalesce(F.col("cost"), F.lit(0.0)), model)
        + [
            _leg("truth.state", task, "tasks", F.lit(-1.0), F.struct(F.lit("WIP").alias("from"))),
            _leg("truth.state", task, "tasks", F.lit(1.0), F.struct(final.alias("to"))),
            gain[1],
            gain[0],
        ]
    )
    return _legs(tasks, F.concat(F.col("run_id"), F.lit(":task:"), F.col("task_id")), "task_complete", legs)


# ---------------------------------------------------------------- checks


def check_event_balance(postings: DataFrame, eps: float = EVENT_EPSILON) -> DataFrame:
    """Events whose legs do not cancel within an account type and unit."""
    net = postings.groupBy("event_id", "account_type", "unit").agg(F.sum("delta_numeric").alias("net"))
    return net.filter(F.abs("net") > eps)


def scope_postings(postings: DataFrame, events: DataFrame, run) -> DataFrame:
    """Postings of one run; ``None`` is the run without an id."""
    chosen = events.filter(F.col("run_id").eqNullSafe(F.lit(run).cast("string"))).select("event_id").distinct()
    return postings.join(chosen, "event_id", "left_semi")


def trial_balance(
    postings: DataFrame, events: DataFrame | None = None, run=ALL_RUNS, eps: float = DATASET_EPSILON
) -> DataFrame:
    """Slices (account type, unit) whose net is not zero; for one run when ``run`` is given."""
    scoped = postings if run is ALL_RUNS else scope_postings(postings, events, run)
    net = scoped.groupBy("account_type", "unit").agg(F.sum("delta_numeric").alias("net"))
    return net.filter(F.abs("net") > eps)


def trial_balance_by_run(postings: DataFrame, events: DataFrame, eps: float = DATASET_EPSILON) -> DataFrame:
    """Violating slices of every run at once, the run without an id included."""
    runs = events.select("event_id", "run_id").distinct()
    net = postings.join(runs, "event_id").groupBy("run_id", "account_type", "unit").agg(
        F.sum("delta_numeric").alias("net")
    )
    return net.filter(F.abs("net") > eps)


def postings_rollup(postings: DataFrame, events: DataFrame | None = None, run=ALL_RUNS) -> DataFrame:
    """Net, positive flow and posting count per account type and unit."""
    scoped = postings if run is ALL_RUNS else scope_postings(postings, events, run)
    delta = F.col("delta_numeric")
    return scoped.groupBy("account_type", "unit").agg(
        F.sum(delta).alias("net"),
        F.sum(F.when(delta > 0, delta).otherwise(0.0)).alias("flow"),
        F.count(F.lit(1)).alias("posting_count"),
    )


def verify_ledger(events: DataFrame, postings: DataFrame, eps: float = DATASET_EPSILON) -> DataFrame:
    """Row counts, unbalanced slices and the kind histogram as (metric, key, value)."""

    def long(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.alias("key"), value.cast("double").alias("value"))

    n = F.count(F.lit(1)).alias("n")
    parts = [
        long(events.agg(n), "events", F.lit(""), F.col("n")),
        long(postings.agg(n), "postings", F.lit(""), F.col("n")),
        long(trial_balance(postings, eps=eps), "violation", F.concat_ws("/", "account_type", "unit"), F.col("net")),
        long(events.groupBy("kind").agg(n), "kind", F.col("kind"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def account_balance_one_side(
    postings: DataFrame, account_type: str, role: str = "project", sign: int = 1, dims: list[str] | None = None
) -> DataFrame:
    """Sum of one side of the ledger per dimension read from ``dims_json``."""
    dims = ["model", "phase"] if dims is None else dims
    side = postings.filter(
        (F.col("account_type") == account_type) & (F.split_part("account_id", F.lit(":"), F.lit(1)) == role)
    )
    keys = [F.get_json_object("dims_json", f"$.{d}").alias(d) for d in dims]
    return side.groupBy(*keys).agg((F.sum("delta_numeric") * sign).alias("total"))


def ops_latency(events: DataFrame, postings: DataFrame, role: str = "provider") -> DataFrame:
    """Time booked on the agent side of completion events, per run."""
    done = events.filter(F.col("kind") == "model_completion").select("event_id", "run_id").distinct()
    time = postings.filter(
        F.col("account_type").isin(LATENCY_ACCOUNTS)
        & (F.split_part("account_id", F.lit(":"), F.lit(1)) == role)
    )
    return time.join(done, "event_id").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("completions"), F.sum(F.abs("delta_numeric")).alias("latency_ms")
    )


def exchange_completeness(events: DataFrame) -> DataFrame:
    """Exchanges without exactly one prompt and one completion."""
    exchange = F.get_json_object("payload_json", "$.exchange_id")
    calls = events.filter(F.col("kind").isin("model_prompt", "model_completion")).select(
        exchange.alias("exchange_id"), "kind"
    )
    counts = calls.groupBy("exchange_id").agg(
        F.count_if(F.col("kind") == "model_prompt").alias("prompts"),
        F.count_if(F.col("kind") == "model_completion").alias("completions"),
    )
    return counts.filter((F.col("prompts") != 1) | (F.col("completions") != 1))


def task_lifecycle_check(events: DataFrame) -> DataFrame:
    """Lifecycle counters per task: starts, ends, moves after the end, broken chains, open tasks."""
    moves = events.filter(F.col("kind") == "state_move").select(
        F.col("actor_task_id").alias("task_id"),
        "event_time",
        "event_id",
        F.get_json_object("payload_json", "$.from").alias("from_state"),
        F.get_json_object("payload_json", "$.to").alias("to_state"),
    )
    chained = previous_values(
        moves,
        ["task_id"],
        ["event_time", "event_id"],
        {"to_state": "previous_state"},
    )
    terminal = F.col("to_state").isin("DONE", "FAILED")
    ends = moves.filter(terminal).groupBy("task_id").agg(
        F.min(F.struct("event_time", "event_id")).alias("_end")
    )
    marked = join_null_safe(chained, ends, ["task_id"], "left")
    after = F.struct("event_time", "event_id") > F.col("_end")
    return marked.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("moves"),
        F.count_if((F.col("from_state") == "NEW") & (F.col("to_state") == "WIP")).alias("starts"),
        F.count_if(terminal).alias("ends"),
        F.count_if(after).alias("moves_after_end"),
        F.count_if(F.col("previous_state") != F.col("from_state")).alias("broken_links"),
        (F.count_if(terminal) == 0).alias("is_open"),
    )


def orphan_postings(postings: DataFrame, events: DataFrame) -> DataFrame:
    """Postings whose event does not exist."""
    return add_missing(postings, events, ["event_id"])


# ---------------------------------------------------------------- privacy, pressure, learning


def privacy_hash(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Replace text columns by hashes: ``texts`` maps a column to the name of its hash."""
    out = df
    for column, name in texts.items():
        out = out.withColumn(name, text_hash(F.col(column)))
    return out.drop(*texts)


def backpressure_shed(events: DataFrame, budget: int) -> DataFrame:
    """Drop payloads above ``budget`` characters and flag them; nothing else is lost."""
    large = F.coalesce(F.length("payload_json") > budget, F.lit(False))
    return events.withColumn("payload_shed", large).withColumn(
        "payload_json", F.when(~F.col("payload_shed"), F.col("payload_json"))
    )


def learn_maintain_rollup(events: DataFrame) -> DataFrame:
    """Questions, errors, cost and time of learn and maintain events per run and kind."""
    typed = events.filter(F.col("kind").rlike("^(learn|maintain)_")).select(
        "run_id",
        "kind",
        F.from_json(
            "payload_json", "question_id string, error string, cost_cents double, wall_ms double"
        ).alias("p"),
    )
    return typed.groupBy("run_id", "kind").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("p.question_id").alias("questions"),
        F.count("p.error").alias("errors"),
        F.sum(F.coalesce("p.cost_cents", F.lit(0.0))).alias("cost_cents"),
        F.sum("p.wall_ms").alias("wall_ms"),
    )
