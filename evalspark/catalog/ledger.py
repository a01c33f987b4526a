"""Registered queries of the event ledger family."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.catalog.inputs import Inputs
from evalspark.catalog.registry import Registry
from evalspark.functions import ids
from evalspark.operators import ledger as L
from evalspark.operators import rules as R
from evalspark.session import fresh_dir
from evalspark.sources import ledger_files as LF
from evalspark.sources import tables as TB

# newest row per id; the retry copies only differ in their arrival time
_DEDUPED = "select * exclude (rn) from (select *, row_number() over (partition by event_id order by ingest_time desc) as rn from ledger_events) where rn = 1"
_D = {"deduped": _DEDUPED}


def _events(t: Inputs):
    return L.dedupe_latest(t.ledger_events, "event_id", ["ingest_time"])


def _stored(t: Inputs):
    folder = fresh_dir(t.spark, "ledger")
    LF.write_ledger(t.ledger_events, t.ledger_postings, folder)
    return LF.read_ledger(t.spark, folder)


def _half(t: Inputs, first: bool):
    hour = F.hour("event_time")
    return t.ledger_events.filter(hour < 14 if first else hour >= 10)


def _legs(name: str, key: str, kind: str, legs: list[tuple[str, str, str, str, str]]) -> str:
    """SQL for a builder: (account_type, account, unit, delta, dims) per leg, NULL deltas dropped."""
    parts = [
        f"select {key} as idempotency_key, '{kind}' as kind, {i} as pos, '{t}' as account_type, {a} as account_id, "
        f"'{u}' as unit, cast({d} as double) as delta_numeric, {j} as dims_json from {name}"
        for i, (t, a, u, d, j) in enumerate(legs)
    ]
    return (
        "select idempotency_key, kind, cast(row_number() over (partition by idempotency_key, kind order by pos) - 1 as integer) as leg, "
        f"account_type, account_id, unit, delta_numeric, dims_json from ({' union all '.join(parts)}) where delta_numeric is not null"
    )


def _pair(t: str, giver: str, taker: str, unit: str, amount: str, dims: str) -> list[tuple[str, str, str, str, str]]:
    return [(t, giver, unit, f"-({amount})", dims), (t, taker, unit, amount, dims)]


_PROVIDER, _PROJECT, _VENDOR = "'provider:' || provider", "'project:' || project_id", "'vendor:' || provider"
_AGENT, _TASK = "'agent:' || agent_id", "'task:' || task_id"
_MODEL = """'{"model":"' || model || '"}'"""
_WALL = """'{"kind":"wall"}'"""


def _phase(p: str) -> str:
    return f"""'{{"model":"' || model || '","phase":"{p}"}}'"""


# the namespace of all ids, written down from its definition and not taken from the operator
_NAMESPACE = "8ba6b5dc1c1c5d299b0e43c4d2c3a9f1"
_POSTING_NAME = "event_id || chr(0) || 'posting:' || position"


def _name_hash(name: str) -> str:
    return f"sha1(unhex('{_NAMESPACE}') || encode({name}))"


def _name_based(h: str) -> str:
    """SQL for the version 5 UUID of a SHA-1 in hex: version digit 5, the variant's upper bits 10."""
    variant = f"case when substr({h}, 17, 1) in ('0', '4', '8', 'c') then '8' when substr({h}, 17, 1) in ('1', '5', '9', 'd') then '9' when substr({h}, 17, 1) in ('2', '6', 'a', 'e') then 'a' else 'b' end"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _star(t: Inputs, layout) -> dict[str, DataFrame]:
    """All five files of the star, written once and loaded in a layout; dimensions with lists are JSON."""
    folder = fresh_dir(t.spark, "star")
    tables = {
        "payments": t.payments,
        "acquirer_countries": t.acquirer_countries,
        "merchant_category_codes": t.mcc_codes,
        "merchant_data": t.merchants,
        "fees": t.fees_list,
    }
    paths = {n: f"{folder}/{n}.{'json' if n in ('merchant_data', 'fees') else 'csv'}" for n in tables}
    for n, df in tables.items():
        df.write.option("header", "true").format(paths[n].rpartition(".")[2]).save(paths[n])
    schemas = {n: df.schema for n, df in tables.items()}
    return TB.load_star(t.spark, paths, schemas, *layout(schemas))


def _register_star(r: Registry) -> None:
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    r.add(
        "load_star",
        lambda t: _star(t, TB.placeholder_layout)["table_1"].groupBy("column_b", "column_c").agg(
            F.count(F.lit(1)).alias("n"), F.sum("column_g").alias("amount")
        ),
        "select merchant as column_b, card_scheme as column_c, count(*) as n, sum(eur_amount) as amount from payments group by 1, 2",
        doubles="amount",
        digits=2,
    )
    r.add(
        "load_star_payments",
        lambda t: _star(t, lambda _: TB.descriptive_layout())["payments"],
        """
        select psp_reference as transaction_id, merchant as merchant_id, card_scheme, year, day_of_year, is_credit, eur_amount as transaction_amount_eur,
            issuing_country as card_issuing_country_code, acquirer_country as acquirer_country_code, email_address, shopper_interaction,
            has_fraudulent_dispute as is_fraudulent_dispute, is_refused, aci as authorization_characteristics_indicator from payments
        """,
        doubles="transaction_amount_eur",
    )
    r.add(
        "load_star_merchants",
        lambda t: _star(t, lambda _: TB.descriptive_layout())["merchants"].withColumn("acquirers", listed("acquirers")),
        """
        select merchant as merchant_id, capture_delay as capture_delay_days_or_immediate_or_manual, array_to_string(acquirer, '|') as acquirers,
            merchant_category_code, account_type from merchants
        """,
    )
    r.add(
        "load_star_fee_rules",
        lambda t: _star(t, lambda _: TB.descriptive_layout())["fee_rules"].withColumns(
            {c: listed(c) for c in ("card_scheme_filter", "account_types_filter_empty_means_any", "mccs_filter_empty_means_any", "acis_filter_empty_means_any")}
        ),
        """
        select id as fee_rule_id, array_to_string(card_scheme, '|') as card_scheme_filter, array_to_string(account_type, '|') as account_types_filter_empty_means_any,
            array_to_string(merchant_category_code, '|') as mccs_filter_empty_means_any, array_to_string(aci, '|') as acis_filter_empty_means_any,
            fixed_amount as fixed_fee_eur, rate as variable_rate_bps from fees_list
        """,
        doubles="fixed_fee_eur",
    )
    r.add(
        "load_star_lookups",
        lambda t: (lambda s: s["acquirer_countries"].select(F.col("acquirer_name").alias("name"), F.col("country_code").alias("value")).unionByName(
            s["merchant_category_codes"].select(F.col("mcc").alias("name"), F.col("mcc_description").alias("value"))
        ))(_star(t, lambda _: TB.descriptive_layout())),
        "select acquirer as name, country_code as value from acquirer_countries union all select mcc, description from mcc_codes",
    )

    def fees_met(t: Inputs):
        star = _star(t, TB.placeholder_layout)
        back = {n: {new: old for old, new in cols.items()} for n, cols in TB.placeholder_layout(
            {"payments": t.payments.schema, "acquirer_countries": t.acquirer_countries.schema, "merchant_category_codes": t.mcc_codes.schema, "merchant_data": t.merchants.schema, "fees": t.fees_list.schema}
        )[0].items()}
        payments, merchants, fees = (star[f"table_{i}"].withColumnsRenamed(back[n]) for i, n in ((1, "payments"), (4, "merchant_data"), (5, "fees")))
        dims = ["card_scheme", "account_type", "merchant_category_code", "aci"]
        return R.rule_usage(partial(R.list_rule_join, dims=dims, list_dims=dims), R.payment_facts(payments, merchants), fees, dims)

    anything = lambda d, v: f"(coalesce(len(f.{d}), 0) = 0 or list_contains(f.{d}, {v}))"
    r.add(
        "load_star_fee_matches",
        fees_met,
        f"""
        select f.id as fees_id, count(*) as pairs, sum(p.eur_amount) as amount from payments p join merchants m on p.merchant = m.merchant join fees_list f
            on {anything('card_scheme', 'p.card_scheme')} and {anything('account_type', 'm.account_type')}
            and {anything('merchant_category_code', 'm.merchant_category_code')} and {anything('aci', 'p.aci')} group by 1
        """,
        doubles="amount",
        digits=2,
    )


def register(r: Registry) -> None:
    r.add(
        "read_ledger",
        lambda t: _stored(t)[0],
        f"select {', '.join(LF.EVENT_SCHEMA.fieldNames())} from deduped",
        extra=_D,
    )
    r.add("read_ledger_postings", lambda t: _stored(t)[1], "select * from ledger_postings", doubles="delta_numeric")
    r.add(
        "normalize_contract",
        lambda t: LF.normalize_contract(
            t.events.select(
                F.col("event_id"),
                F.col("ts").alias("event_time"),
                F.col("event_type").alias("kind"),
                F.from_json("props", "k bigint").alias("payload_json"),
            ),
            "events",
        ).select("event_id", "event_time", "kind", "run_id", "payload_json"),
        "select cast(event_id as varchar) as event_id, cast(ts as timestamp) as event_time, event_type as kind, "
        "cast(null as varchar) as run_id, replace(props, ' ', '') as payload_json from events",
    )
    r.add("dedupe_latest", _events, "select * from deduped", extra=_D)
    r.add(
        "ingest_idempotent",
        lambda t: L.ingest_idempotent(_half(t, False), _half(t, True), "event_id", ["ingest_time"])[0],
        "select * from deduped where hour(event_time) >= 10 and event_id not in "
        "(select event_id from ledger_events where hour(event_time) < 14)",
        extra=_D,
    )
    r.add(
        "ingest_counts",
        lambda t: L.ingest_idempotent(_half(t, False), _half(t, True), "event_id", ["ingest_time"])[1],
        "select count(*) as received, count(distinct event_id) as distinct_ids, count(distinct event_id) filter "
        "(event_id not in (select event_id from ledger_events where hour(event_time) < 14)) as inserted "
        "from ledger_events where hour(event_time) >= 10",
    )
    r.add(
        "missing_ids",
        lambda t: L.missing_ids(t.ledger_events, _half(t, True), "event_id")[1],
        "select count(*) as missing, (select string_agg(event_id, ',' order by event_id) from (select event_id from lost order by 1 limit 5)) as sample from lost",
        extra={
            "lost": "select distinct event_id from ledger_events where event_id not in (select event_id from ledger_events where hour(event_time) < 14)"
        },
    )

    def permissive(t: Inputs):
        folder = fresh_dir(t.spark, "lines")
        broken = F.when(F.col("event_id") % 7 == 0, F.lit('{"id": ')).otherwise(
            F.to_json(F.struct(F.col("event_id").alias("id"), F.array(F.col("event_type")).alias("tags")))
        )
        t.events.select(broken.alias("value")).write.text(folder)
        schema = T.StructType().add("id", "long").add("tags", T.ArrayType(T.StringType()))
        good, bad = LF.read_json_permissive(t.spark, folder, schema, ["tags"])
        return good.select("id", "tags").unionByName(bad.groupBy().agg(F.lit(-1).cast("bigint").alias("id"), F.count(F.lit(1)).cast("string").alias("tags")))

    r.add(
        "ingest_json_permissive",
        permissive,
        """select event_id as id, '["' || event_type || '"]' as tags from events where event_id % 7 <> 0
        union all select -1, cast(count(*) as varchar) from events where event_id % 7 = 0""",
    )

    _register_star(r)

    databases = {
        "geo": ["region", "nation"],
        "trade": ["customer", "supplier", "part", "orders", "lineitem"],
        "activity": ["events", "conversations"],
        "corpus": ["documents", "embeddings", "pages", "benchmark", "labels"],
    }

    def copied(t: Inputs):
        folder = fresh_dir(t.spark, "copy")
        done = TB.copy_schema_tables({d: {n: t.table(n) for n in ns} for d, ns in databases.items()}, folder)
        counts = [
            t.spark.read.parquet(f"{folder}/{d}/{n}").agg(
                F.lit(d).alias("database"), F.lit(n).alias("table"), F.count(F.lit(1)).alias("n")
            )
            for d, ns in done.items()
            for n in ns
        ]
        return reduce(DataFrame.unionByName, counts)

    r.add(
        "copy_schema_tables",
        copied,
        " union all ".join(
            f"select '{d}' as database, '{n}' as \"table\", count(*) as n from {n}" for d, ns in databases.items() for n in ns
        ),
    )
    r.add(
        "sample_rows",
        lambda t: TB.sample_rows(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 20),
        "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 20",
    )

    def replaced(t: Inputs):
        path = fresh_dir(t.spark, "slices")
        n = F.count(F.lit(1)).alias("n")
        old = t.ledger_events.groupBy(F.col("project_id").alias("schema_name"), "kind").agg(n)
        TB.write_partition_replace(old, path)
        TB.write_partition_replace(old.filter("schema_name = 'p1'").withColumn("n", F.col("n") * 10), path)
        return t.spark.read.schema("kind string, n bigint, schema_name string").parquet(path)

    r.add(
        "write_partition_replace",
        replaced,
        "select project_id as schema_name, kind, count(*) * case when project_id = 'p1' then 10 else 1 end as n from ledger_events group by 1, 2",
    )

    def exported(t: Inputs):
        path = fresh_dir(t.spark, "csv")
        table = t.ledger_events.groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n"))
        TB.export_csv(table, path)
        return TB.read_csv(t.spark, path, table.schema)

    r.add("export_csv", exported, "select run_id, kind, count(*) as n from ledger_events group by 1, 2")

    # ---- ids and dims
    r.add(
        "deterministic_event_id",
        lambda t: L.with_event_ids(_events(t).drop("event_id")).groupBy("project_id").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"),
            F.count_if(F.col("event_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"),
        ),
        "select project_id, count(*) as n, count(distinct idempotency_key) as ids, count(*) as well_formed from deduped group by 1",
        extra=_D,
    )
    r.add(
        "deterministic_event_id_values",
        lambda t: L.with_event_ids(_events(t).drop("event_id")).select("project_id", "idempotency_key", "event_id"),
        f"select project_id, idempotency_key, {_name_based('hash')} as event_id from "
        f"(select *, {_name_hash('project_id || chr(0) || idempotency_key')} as hash from deduped)",
        extra=_D,
    )
    legs = "(select event_id, unnest(['a', 'b']) as account_id, unnest([0, 1]) as position from deduped)"
    r.add(
        "deterministic_posting_id",
        lambda t: L.with_posting_ids(
            _events(t).select(
                "event_id",
                F.array(F.struct(F.lit("a").alias("account_id")), F.struct(F.lit("b").alias("account_id"))).alias("postings"),
            )
        ),
        f"select {_name_based('hash')} as posting_id, event_id, position, account_id from "
        f"(select *, {_name_hash(_POSTING_NAME)} as hash from {legs})",
        extra=_D,
    )
    r.add(
        "uuid7_time",
        lambda t: t.events.select(
            "event_id",
            ids.uuid7_time(
                F.concat(
                    F.substring(F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 12, "0"), 1, 8), F.lit("-"),
                    F.substring(F.lpad(F.lower(F.hex(F.unix_millis(F.col("ts").cast("timestamp")))), 12, "0"), 9, 4),
                    F.lit("-7abc-8def-0123456789ab"),
                )
            ).alias("created"),
        ),
        "select event_id, cast(date_trunc('millisecond', ts) as timestamp) as created from events",
    )
    r.add(
        "merge_default_dims",
        lambda t: t.events.select(
            "event_id",
            L.merge_default_dims(
                F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("model"), F.col("event_type"))),
                {"model": "base", "phase": "prompt"},
            ).alias("d"),
        ).select("event_id", F.col("d")["model"].alias("model"), F.col("d")["phase"].alias("phase")),
        "select event_id, case when event_id % 3 = 0 then event_type else 'base' end as model, 'prompt' as phase from events",
    )

    # ---- builders
    prompt = _pair("resource.tokens", _PROVIDER, _PROJECT, "+tokens", "prompt_tokens", _phase("prompt"))
    done = (
        _pair("resource.tokens", _PROVIDER, _PROJECT, "+tokens", "completion_tokens", _phase("completion"))
        + _pair("truth.time", _AGENT, _PROJECT, "ms", "wall_ms", _WALL)
        + _pair("truth.money", _VENDOR, _PROJECT, "$", "cost_money", _MODEL)
    )
    r.add(
        "build_postings_model_call",
        lambda t: L.build_postings_model_call(t.calls),
        _legs("calls", "exchange_id || ':prompt'", "model_prompt", prompt)
        + " union all "
        + _legs("calls", "exchange_id || ':completion'", "model_completion", done),
        doubles="delta_numeric",
    )
    r.add(
        "build_postings_state_move",
        lambda t: L.build_postings_state_move(t.calls),
        _legs(
            "calls",
            "coalesce(move_key, task_id || ':' || from_state || ':' || to_state)",
            "state_move",
            [
                ("truth.state", _TASK, "tasks", "-1", """'{"from":"' || from_state || '"}'"""),
                ("truth.state", _TASK, "tasks", "1", """'{"to":"' || to_state || '"}'"""),
            ],
        ),
    )
    metric = """'{"metric":"' || metric || '"}'"""
    r.add(
        "build_postings_utility",
        lambda t: L.build_postings_utility(t.calls),
        _legs(
            "calls",
            "event_key",
            "utility",
            [
                ("truth.utility", _TASK, "points", "score", metric),
                ("truth.utility", _PROJECT, "points", "-(score)", metric),
            ],
        ),
        doubles="delta_numeric",
    )
    reward, reward_dims = "case when is_correct then 1 else 0 end", """'{"metric":"reward"}'"""
    r.add(
        "build_postings_task_complete",
        lambda t: L.build_postings_task_complete(
            t.calls.withColumnsRenamed({"prompt_tokens": "total_tokens", "cost_money": "cost"})
        ),
        _legs(
            "calls",
            "run_id || ':task:' || task_id",
            "task_complete",
            _pair("resource.tokens", _PROVIDER, _PROJECT, "+tokens", "prompt_tokens", _MODEL)
            + _pair("truth.time", _AGENT, _PROJECT, "ms", "wall_ms", _WALL)
            + _pair("truth.money", _VENDOR, _PROJECT, "$", "coalesce(cost_money, 0)", _MODEL)
            + [
                ("truth.state", _TASK, "tasks", "-1", """'{"from":"WIP"}'"""),
                ("truth.state", _TASK, "tasks", "1", """'{"to":"' || case when finished then 'DONE' else 'FAILED' end || '"}'"""),
                ("truth.utility", _TASK, "points", reward, reward_dims),
                ("truth.utility", _PROJECT, "points", f"-({reward})", reward_dims),
            ],
        ),
        doubles="delta_numeric",
    )

    # ---- checks
    r.add(
        "check_event_balance",
        lambda t: L.check_event_balance(t.ledger_postings),
        "select event_id, account_type, unit, sum(delta_numeric) as net from ledger_postings group by 1, 2, 3 having abs(sum(delta_numeric)) > 1e-9",
        doubles="net",
    )
    r.add(
        "trial_balance",
        lambda t: L.trial_balance(t.ledger_postings),
        "select account_type, unit, sum(delta_numeric) as net from ledger_postings group by 1, 2 having abs(sum(delta_numeric)) > 1e-4",
        doubles="net",
    )
    by_run = "select e.run_id, p.account_type, p.unit, sum(p.delta_numeric) as net from ledger_postings p join deduped e using (event_id) group by 1, 2, 3 having abs(sum(p.delta_numeric)) > 1e-4"
    r.add(
        "trial_balance_by_run",
        lambda t: L.trial_balance_by_run(t.ledger_postings, _events(t)),
        by_run,
        doubles="net",
        extra=_D,
    )
    r.add(
        "trial_balance_null_run",
        lambda t: L.trial_balance(t.ledger_postings, _events(t), run=None),
        f"select account_type, unit, net from ({by_run}) where run_id is null",
        doubles="net",
        extra=_D,
    )
    r.add(
        "verify_ledger",
        lambda t: L.verify_ledger(_events(t), t.ledger_postings),
        """
        select 'events' as metric, '' as key, cast(count(*) as double) as value from deduped
        union all select 'postings', '', count(*) from ledger_postings
        union all select 'violation', account_type || '/' || unit, sum(delta_numeric) from ledger_postings
            group by account_type, unit having abs(sum(delta_numeric)) > 1e-4
        union all select 'kind', kind, count(*) from deduped group by kind
        """,
        doubles="value",
        extra=_D,
    )
    r.add(
        "postings_rollup",
        lambda t: L.postings_rollup(t.ledger_postings),
        "select account_type, unit, sum(delta_numeric) as net, sum(case when delta_numeric > 0 then delta_numeric else 0 end) as flow, "
        "count(*) as posting_count from ledger_postings group by 1, 2",
        doubles="net flow",
        digits=3,
    )
    r.add(
        "account_balance_one_side",
        lambda t: L.account_balance_one_side(t.ledger_postings, "resource.tokens"),
        "select dims_json->>'$.model' as model, dims_json->>'$.phase' as phase, sum(delta_numeric) as total from ledger_postings "
        "where account_type = 'resource.tokens' and account_id like 'project:%' group by 1, 2",
        doubles="total",
    )
    r.add(
        "ops_latency",
        lambda t: L.ops_latency(_events(t), t.ledger_postings),
        "select e.run_id, count(*) as completions, sum(abs(p.delta_numeric)) as latency_ms from ledger_postings p join deduped e using (event_id) "
        "where e.kind = 'model_completion' and p.account_type in ('truth.time', 'resource.time_ms') and p.account_id like 'provider:%' group by 1",
        doubles="latency_ms",
        digits=3,
        extra=_D,
    )
    r.add(
        "exchange_completeness",
        lambda t: L.exchange_completeness(_events(t)),
        """
        select payload_json->>'$.exchange_id' as exchange_id, count(*) filter (kind = 'model_prompt') as prompts,
            count(*) filter (kind = 'model_completion') as completions
        from deduped where kind in ('model_prompt', 'model_completion') group by 1 having not (prompts = 1 and completions = 1)
        """,
        extra=_D,
    )
    r.add(
        "task_lifecycle_check",
        lambda t: L.task_lifecycle_check(_events(t)),
        """
        select task_id, count(*) as moves, count(*) filter (f = 'NEW' and s = 'WIP') as starts,
            count(*) filter (s in ('DONE', 'FAILED')) as ends, count(*) filter (pos > first_end) as moves_after_end,
            count(*) filter (prev <> f) as broken_links, count(*) filter (s in ('DONE', 'FAILED')) = 0 as is_open
        from (select *, min(case when s in ('DONE', 'FAILED') then pos end) over (partition by task_id) as first_end,
                lag(s) over (partition by task_id order by pos) as prev from (
            select actor_task_id as task_id, payload_json->>'$.from' as f, payload_json->>'$.to' as s,
                row_number() over (partition by actor_task_id order by event_time, event_id) as pos
            from deduped where kind = 'state_move')) group by 1
        """,
        extra=_D,
    )
    r.add(
        "orphan_postings",
        lambda t: L.orphan_postings(t.ledger_postings, t.ledger_events).select("posting_id", "event_id"),
        "select posting_id, event_id from ledger_postings where event_id not in (select event_id from ledger_events)",
    )
    r.add(
        "privacy_hash",
        lambda t: L.privacy_hash(t.documents.select("doc_id", "text"), {"text": "request_hash"}),
        "select doc_id, sha256(text) as request_hash from documents",
    )
    r.add(
        "backpressure_shed",
        lambda t: L.backpressure_shed(
            t.documents.select("doc_id", F.col("text").alias("payload_json")), 2000
        ).select("doc_id", "payload_shed", F.length("payload_json").alias("kept_chars")),
        "select doc_id, length(text) > 2000 as payload_shed, cast(case when length(text) > 2000 then null else length(text) end as integer) as kept_chars from documents",
    )
    r.add(
        "learn_maintain_rollup",
        lambda t: L.learn_maintain_rollup(_events(t)),
        """
        select run_id, kind, count(*) as events, count(distinct payload_json->>'$.question_id') as questions,
            count(payload_json->>'$.error') as errors,
            sum(coalesce(cast(payload_json->>'$.cost_cents' as double), 0)) as cost_cents, sum(cast(payload_json->>'$.wall_ms' as double)) as wall_ms
        from deduped where kind like 'learn\\_%' escape '\\' or kind like 'maintain\\_%' escape '\\' group by 1, 2
        """,
        doubles="cost_cents wall_ms",
        extra=_D,
    )
