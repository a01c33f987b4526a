"""Operator inputs shaped from the given tables.

Each input is one SELECT that both Spark and the checking engine understand, so that a query
and its check read the same rows. ``{name}`` stands for a relation, ``@word@`` for one of the
few places where the dialects differ.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# dialect differences: (Spark, checking engine)
_DIALECT = {
    "@legs@": ("explode(array(0, 1, 2, 3))", "unnest([0, 1, 2, 3])"),
    "@array@": ("array", "list_value"),
    "@doy@": ("dayofyear", "dayofyear"),
}

_MONEY = "cast(floor({c} / 100) as bigint)"


def _cents(c: str) -> str:
    return f"cast(cast(floor(({c}) / 100) as bigint) as string) || '.' || lpad(cast(({c}) % 100 as string), 2, '0')"


def _scaled(c: str, unit: int, digits: int) -> str:
    return (
        f"cast(cast(floor(({c}) / {unit}) as bigint) as string) || '.' || "
        f"lpad(cast(({c}) % {unit} as string), {digits}, '0')"
    )


_EVENT_COLUMNS = """
    cast(event_id as string) as event_id,
    cast(ts as timestamp) as event_time,
    cast(ts as timestamp) + interval '1' minute * (event_id % 3 + @late@) as ingest_time,
    case event_id % 8
        when 0 then 'model_prompt'
        when 1 then case when event_type = 'error' then 'task_failed' else 'model_completion' end
        when 2 then 'state_move'
        when 3 then 'state_move'
        when 4 then 'model_prompt'
        when 5 then 'model_completion'
        when 6 then case when event_type = 'purchase' then 'learn_question' else 'utility' end
        else 'evaluation_result' end as kind,
    'agent-' || cast(user_id % 5 as string) as actor_agent_id,
    't' || cast(user_id as string) as actor_task_id,
    'p' || cast(user_id % 3 as string) as project_id,
    case when user_id % 11 = 0 then null else 'run-' || cast(user_id % 10 as string) end as run_id,
    'sdk' as source,
    'k' || cast(event_id as string) as idempotency_key,
    '{{"exchange_id":"x' || cast(cast(floor(event_id / 2) as bigint) as string)
        || '","phase":"' || case event_id % 2 when 0 then 'prompt' else 'completion' end
        || '","question_id":"' || case when event_id % 3 = 0 then 'q' else '' end || cast(user_id as string)
        || '","is_correct":' || case event_type when 'click' then 'true' when 'view' then 'true' else 'false' end
        || ',"model":"m' || cast(event_id % 3 as string)
        || '","provider":"v' || cast(event_id % 2 as string)
        || '","tokens":' || cast(cast(floor(value) as bigint) as string)
        || ',"wall_ms":' || cast(cast(floor(value * 10) as bigint) as string)
        || ',"cost_cents":' || case when event_id % 5 = 0 then 'null' else cast(cast(floor(value) as bigint) % 97 as string) end
        || ',"from":"' || case event_id % 8 when 2 then 'NEW' else 'WIP' end
        || '","to":"' || case when event_id % 8 = 2 then 'WIP' when event_type = 'error' then 'FAILED' else 'DONE' end
        || '","error":' || case when event_type = 'purchase' and event_id % 5 = 1 then '"timeout"' else 'null' end
        || '}}' as payload_json
"""

# inputs that Spark reads in another form of the same rows
_ON_SPARK = {"result_base": "result_base_by_case", "result_cells": "result_cells_at_once"}

# name -> (relations it reads, SELECT text)
INPUTS: dict[str, tuple[tuple[str, ...], str]] = {}


def _define(name: str, deps: str, sql: str) -> None:
    INPUTS[name] = (tuple(deps.split()), sql)


# events with a retry copy of every 17th one, which arrived a minute later
_define(
    "ledger_events",
    "events",
    "select " + _EVENT_COLUMNS.replace("@late@", "0") + " from {events} union all select "
    + _EVENT_COLUMNS.replace("@late@", "1") + " from {events} where event_id % 17 = 0",
)
_define(
    "ledger_postings",
    "events",
    """
    select cast(event_id as string) || '-' || cast(leg as string) as posting_id,
        case when event_id % 1009 = 0 then 'lost-' else '' end || cast(event_id as string) as event_id,
        case when leg < 2 then case event_id % 8
                when 0 then 'resource.tokens' when 1 then 'resource.tokens' when 2 then 'truth.state'
                when 3 then 'truth.state' when 4 then 'resource.tokens' when 5 then 'resource.time_ms'
                when 6 then 'truth.utility' else 'value.utility' end
            else case event_id % 3 when 0 then 'truth.money' when 1 then 'truth.time' else 'resource.money' end
            end as account_type,
        case when leg % 2 = 0 then 'provider:v' || cast(event_id % 2 as string)
            else 'project:p' || cast(user_id % 3 as string) end as account_id,
        case when leg < 2 then case event_id % 8
                when 0 then '+tokens' when 1 then '+tokens' when 2 then 'tasks' when 3 then 'tasks'
                when 4 then '+tokens' when 5 then 'ms' when 6 then 'points' else 'points' end
            else case event_id % 3 when 0 then '$' when 1 then 'ms' else case when event_id % 2 = 0 then '$' else 'eur' end end
            end as unit,
        case when leg % 2 = 0 then -1 else 1 end * case when leg < 2 then floor(value) else round(value, 2) end as delta_numeric,
        '{{"model":"m' || cast(event_id % 3 as string) || '","phase":"'
            || case event_id % 2 when 0 then 'prompt' else 'completion' end || '"}}' as dims_json
    from (select *, @legs@ as leg from {events}) e
    where not (event_id % 997 = 0 and leg = 1)
    """,
)
_define(
    "payments",
    "lineitem orders customer supplier",
    """
    select cast(l_orderkey as string) || '-' || cast(l_partkey as string) || '-' || cast(l_suppkey as string)
            || '-' || cast(l_linenumber as string) as psp_reference,
        'm' || cast(l_suppkey - l_suppkey % 2 as string) as merchant,
        's' || cast(l_partkey % 4 as string) as card_scheme,
        cast(year(l_shipdate) as int) as year,
        cast(dayofyear(l_shipdate) as int) as day_of_year,
        l_linenumber % 2 = 0 as is_credit,
        cast(floor(cast(round(l_extendedprice * 100) as bigint) * case (l_suppkey - l_suppkey % 2) % 10 when 0 then 1000
            when 2 then 300 when 4 then 100 when 6 then 10 else 1 end / 100) as double) / 100 as eur_amount,
        case when c_nationkey % 9 = 8 then null else 'C' || cast(c_nationkey % 8 as string) end as issuing_country,
        'C' || cast(s_nationkey % 8 as string) as acquirer_country,
        'u' || cast(o_custkey as string) as email_address,
        case l_linenumber % 3 when 0 then 'Ecommerce' when 1 then 'POS' else 'MOTO' end as shopper_interaction,
        l_returnflag = 'R' and l_orderkey % 4 = 0 as has_fraudulent_dispute,
        l_orderkey % 13 = 0 as is_refused,
        case l_orderkey % 7 when 0 then 'A' when 1 then 'B' when 2 then 'C' when 3 then 'D' when 4 then 'E'
            when 5 then 'F' else 'G' end as aci
    from {lineitem} join {orders} on l_orderkey = o_orderkey
        join {customer} on o_custkey = c_custkey join {supplier} on l_suppkey = s_suppkey
    """,
)
_define(
    "merchants",
    "supplier",
    """
    select 'm' || cast(s_suppkey as string) as merchant,
        case s_suppkey % 6 when 0 then '1' when 1 then '2' when 2 then '4' when 3 then '7'
            when 4 then 'immediate' else 'manual' end as capture_delay,
        case s_suppkey % 3 when 0 then @array@('acq' || cast(s_nationkey as string))
            when 1 then @array@('acq' || cast(s_nationkey as string), 'acq' || cast((s_nationkey + 1) % 25 as string))
            else @array@('acq' || cast(s_nationkey as string), 'acq' || cast((s_nationkey + 2) % 25 as string), 'acq99')
            end as acquirer,
        4000 + (s_suppkey * 7) % 50 as merchant_category_code,
        case cast(floor(s_suppkey / 2) as bigint) % 6 when 0 then 'R' when 1 then 'D' when 2 then 'H' when 3 then 'F'
            when 4 then 'S' else 'O' end as account_type
    from {supplier}
    """,
)
_define(
    "acquirer_countries",
    "nation",
    "select 'acq' || cast(n_nationkey as string) as acquirer, 'C' || cast(n_nationkey % 8 as string) as country_code from {nation}",
)
_define(
    "mcc_codes",
    "nation",
    "select cast(4000 + n_nationkey as string) as mcc, n_name as description from {nation}",
)
_ACCOUNT = "case cast(floor({k} / 3) as bigint) % 6 when 0 then 'R' when 1 then 'D' when 2 then 'H' when 3 then 'F' when 4 then 'S' else 'O' end"
_define(
    "fees",
    "part",
    """
    select p_partkey as id,
        case when p_partkey % 10 = 0 then null else 's' || cast(p_partkey % 4 as string) end as card_scheme,
        case when p_partkey % 3 = 0 then null else """ + _ACCOUNT.replace("{k}", "p_partkey") + """ end as account_type,
        case when p_partkey % 2 = 0 then null else case cast(floor(p_partkey / 2) as bigint) % 5 when 0 then '<3' when 1 then '3-5'
            when 2 then '>5' when 3 then 'immediate' else 'manual' end end as capture_delay,
        case when p_partkey % 13 <> 0 then null else case cast(floor(p_partkey / 13) as bigint) % 4 when 0 then '<7.2%'
            when 1 then '7.2%-7.7%' when 2 then '7.7%-8.3%' else '>8.3%' end end as monthly_fraud_level,
        case when p_partkey % 11 <> 0 then null else case cast(floor(p_partkey / 11) as bigint) % 4 when 0 then '<100k'
            when 1 then '100k-1m' when 2 then '1m-5m' else '>5m' end end as monthly_volume,
        case when p_partkey % 7 = 0 then null else 4000 + cast(floor(p_partkey / 7) as bigint) % 50 end as merchant_category_code,
        case when p_partkey % 5 < 2 then null else cast(floor(p_partkey / 5) as bigint) % 2 = 0 end as is_credit,
        case when p_partkey % 4 = 0 then null else case cast(floor(p_partkey / 4) as bigint) % 6 when 0 then 'A' when 1 then 'B'
            when 2 then 'C' when 3 then 'D' when 4 then 'E' else 'F' end end as aci,
        cast((p_size % 14) as double) / 100 as fixed_amount,
        cast(p_partkey % 99 + 1 as int) as rate,
        case when p_partkey % 3 <> 1 then null else cast(cast(floor(p_partkey / 3) as bigint) % 2 as double) end as intracountry
    from {part}
    """,
)
# the same kind of rules with list-valued dimensions: NULL or empty list means any
_define(
    "fees_list",
    "part",
    """
    select p_partkey as id,
        case p_partkey % 3 when 0 then @array@('s' || cast(p_partkey % 4 as string), 's' || cast((p_partkey + 1) % 4 as string)) else null end as card_scheme,
        case p_partkey % 4 when 0 then @emptytext@ when 1 then null else @array@('R', """ + _ACCOUNT.replace("{k}", "p_partkey") + """) end as account_type,
        @array@(4000 + p_partkey % 50, 4000 + (p_partkey * 3) % 50) as merchant_category_code,
        case p_partkey % 5 when 0 then null else @array@('A', 'B', case p_partkey % 2 when 0 then 'C' else 'G' end) end as aci,
        cast((p_size % 14) as double) / 100 as fixed_amount,
        cast(p_partkey % 99 + 1 as int) as rate
    from {part}
    """,
)
_DIALECT["@emptytext@"] = ("cast(array() as array<string>)", "cast([] as varchar[])")

# recorded evaluation results, several attempts per run and question
_LV = "cast(floor(value) as bigint) % 10"
_define(
    "eval_raw",
    "events",
    f"""
    select event_id, cast(ts as timestamp) as event_time,
        'run-' || lpad(cast(event_id % 12 as string), 2, '0') as run_id,
        user_id as question_id,
        'db' || cast(user_id % 7 as string) as db_id,
        case user_id % 3 when 0 then 'simple' when 1 then 'moderate' else 'challenging' end as difficulty,
        'lab/model-' || cast((event_id % 12) % 3 as string) as model,
        case cast(floor((event_id % 12) / 3) as bigint) % 3 when 0 then 'baseline' when 1 then 'comments' else 'full' end as config,
        case when user_id % 10 < 3 then 'train' else 'test' end as phase,
        case when {_LV} < 4 then 'correct' when {_LV} = 4 then 'judge_correct' when {_LV} in (5, 6) then 'partial'
            when {_LV} = 7 then 'incorrect' when {_LV} = 8 then 'error' else 'hit_limit' end as level,
        case when {_LV} = 5 then case event_id % 4 when 0 then 'extra_columns:1' when 1 then 'extra_duplicates:2_duplicates_in_predicted'
                when 2 then 'implicit_distinct:3_duplicates_removed' else 'aggregated_equivalent:4_to_1' end
            when {_LV} = 6 then case event_id % 3 when 0 then 'missing_columns:1' when 1 then 'extra_rows:2' else 'values_close_not_exact' end
            when {_LV} = 7 and event_id % 2 = 0 then 'missing_rows:1' else null end as partial_reason,
        case when {_LV} < 3 then 'gold' when {_LV} = 3 then 'platinum' else 'none' end as match_source,
        {_LV} < 5 as is_correct,
        case when {_LV} = 8 then case event_id % 5 when 0 then 'Binder Error: no column' when 1 then 'Catalog Error: no table'
                when 2 then 'Parser Error: near select' when 3 then 'query Timeout after 30s' else 'Conversion failed' end else null end as error,
        'How many ' || event_type || ' events in total, ' || case user_id % 5 when 0 then 'percentage of all'
            when 1 then 'the most recent' when 2 then 'average value' when 3 then 'count per country' else 'list them' end as question,
        cast(floor(value * 100) as bigint) as cost_units,
        cast(floor(value) as bigint) * 10 as duration_ms,
        event_id % 9 as turns,
        case when event_id % 6 = 0 then 'approve' when event_id % 6 = 1 then 'reject' else null end as review
    from {{events}}
    """,
)
_define(
    "eval_results",
    "eval_raw",
    """
    select event_id, event_time, run_id, question_id, db_id, difficulty, model, config, phase, level, partial_reason,
        match_source, is_correct, error, question, cost_units, cast(cost_units as double) / 10000 as cost, duration_ms, turns, review
    from (select *, row_number() over (partition by run_id, question_id order by event_time desc, event_id desc) as rn from {eval_raw}) r
    where rn = 1
    """,
)
_define(
    "exchanges",
    "events",
    """
    select 'run-' || lpad(cast(user_id as string), 5, '0') as run_id,
        'lab/model-' || cast(user_id % 4 as string) as model,
        event_id % 20 as puzzle_id,
        row_number() over (partition by user_id, event_id % 20 order by ts, event_id) as guess_index,
        'W' || cast(event_id % 16 as string) || ', W' || cast((event_id + 3) % 16 as string) as guess,
        case event_type when 'click' then 'CORRECT' when 'view' then 'CORRECT. NEXT GUESS?' when 'error' then 'INVALID_RESPONSE'
            when 'purchase' then 'INCORRECT' else 'INCORRECT. ONE AWAY' end as result,
        cast(floor(value * 10) as bigint) as latency_ms,
        case when event_id % 9 = 0 then null else cast(floor(value) as bigint) * 3 end as prompt_tokens,
        case when event_id % 8 = 0 then null else cast(floor(value) as bigint) end as completion_tokens,
        case when event_id % 7 = 0 then null else cast(cast(floor(value) as bigint) as double) / 1000 end as cost,
        cast(ts as timestamp) as log_time
    from {events}
    """,
)
_define(
    "summaries",
    "events",
    """
    select 'run-' || lpad(cast(user_id as string), 5, '0') as run_id,
        'lab/model-' || cast(user_id % 4 as string) as model,
        cast(ts as timestamp) as log_time, event_id,
        case when event_id % 7 = 0 then 'failed' when event_id % 5 = 0 then null else 'completed' end as status,
        5 + event_id % 6 as puzzles_attempted,
        event_id % 6 as puzzles_solved,
        cast(event_id % 900 as double) / 10 as avg_time_sec,
        cast(cast(floor(value) as bigint) as double) / 100 as total_cost,
        cast(floor(value) as bigint) * 40 as total_tokens
    from {events} where event_type in ('signup', 'purchase')
    """,
)

# Statement texts of the recorded query log, chosen by event_id modulo their number.
LOG_STATEMENTS = [
    "SELECT o.o_custkey, SUM(o.o_totalprice) AS total FROM shop.orders o JOIN shop.customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_custkey ORDER BY total DESC",
    "SELECT l.l_orderkey, l.l_quantity FROM shop.lineitem l JOIN shop.orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 30 AND o.o_orderstatus = 'F'",
    "SELECT c.c_nationkey, COUNT(c.c_custkey) AS customers FROM shop.customer c GROUP BY c.c_nationkey HAVING COUNT(c.c_custkey) > 10",
    "WITH big AS (SELECT o.o_custkey, AVG(o.o_totalprice) AS mean_price FROM shop.orders o GROUP BY o.o_custkey) SELECT b.o_custkey FROM big b WHERE b.mean_price >= 1000",
    "SELECT p.p_brand, MAX(p.p_retailprice) AS dearest FROM shop.part p WHERE p.p_size BETWEEN 5 AND 15 GROUP BY p.p_brand",
    "SELECT l.l_suppkey FROM shop.lineitem l WHERE l.l_commitdate < l.l_receiptdate AND l.l_discount IN (0.05, 0.07)",
    "SELECT s.s_name FROM shop.supplier s WHERE s.s_acctbal IS NOT NULL AND s.s_name LIKE 'Supplier%'",
    "SELECT n.n_name, SUM(l.l_extendedprice * l.l_discount) AS saved FROM shop.lineitem l JOIN shop.supplier s ON l.l_suppkey = s.s_suppkey JOIN shop.nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY n.n_name LIMIT 10",
    "SELECT COUNT(*) AS rows_total FROM shop.orders o WHERE o.o_orderdate >= '1997-01-01'",
    "SELECT c.c_name FROM shop.customer c LEFT JOIN shop.orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL",
    "UPDATE shop.orders SET o_orderstatus = 'F' WHERE o_orderkey = 7",
    "DELETE FROM shop.part WHERE p_size = 0",
    "USE other; SELECT 1",
    "SELECT t.x FROM other.main.things t WHERE t.x != t.y",
    "EXPLAIN ANALYZE SELECT o.o_orderkey FROM shop.orders o",
    "SELECT query_id FROM information_schema.query_history",
    "WITH a AS (SELECT o.o_custkey, COUNT(*) AS n FROM shop.orders o GROUP BY o.o_custkey), b AS (SELECT c.c_custkey FROM shop.customer c WHERE c.c_name = 'it''s, (not) ours') SELECT a.n FROM a JOIN b ON a.o_custkey = b.c_custkey",
    "SELECT SUM(COALESCE(l.l_tax, 0)) AS total_tax, ROUND(AVG(l.l_discount), 2) AS mean_discount FROM shop.lineitem l WHERE l.l_quantity = (SELECT MAX(m.l_quantity) FROM shop.lineitem m)",
    "SELECT l.l_quantity * (1 - l.l_discount) AS net, CASE WHEN l.l_tax > 0.05 THEN 'high, very' ELSE 'low' END AS level FROM shop.lineitem l",
    "SELECT p.p_name FROM shop.part p WHERE p.p_name = 'it''s' AND p.p_container IN ('a,b', 'c')",
    "SELECT s.s_suppkey, s.s_acctbal - s.s_nationkey AS gap FROM shop.supplier s HAVING COUNT(*) >= 2",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "@q@") + "'"


def _statement_case(texts: list[str], selector: str) -> str:
    arms = " ".join(f"when {i} then {_quoted(t)}" for i, t in enumerate(texts[:-1]))
    return f"replace(case {selector} {arms} else {_quoted(texts[-1])} end, '@q@', chr(39))"


_define(
    "query_log",
    "events",
    f"""
    select cast(event_id as string) as query_id,
        case event_id % 5 when 1 then '  ' || replace(q, ' FROM', '   FROM') || ' ' when 2 then replace(q, 'SELECT', 'select') else q end as query_text,
        'user' || cast(user_id % 6 as string) as user_name,
        cast(ts as timestamp) as start_time,
        cast(floor(value) as bigint) as execution_ms
    from (select *, {_statement_case(LOG_STATEMENTS, f"event_id % {len(LOG_STATEMENTS)}")} as q from {{events}}) e
    """,
)

# gold and predicted result rows per order, with one kind of deviation per case
_define(
    "result_base",
    "lineitem",
    """
    select l_orderkey as case_id, l_orderkey % 14 as kind,
        row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag) as row_no,
        count(*) over (partition by l_orderkey) as n,
        cast(l_partkey as string) as part_text,
        cast(cast(l_quantity as bigint) as string) as qty_text,
        cast(round(l_extendedprice * 100) as bigint) as cents,
        l_returnflag as flag
    from {lineitem}
    """,
)
_PRICE = _cents("cents")
_GOLD_CELLS = f"""case when kind = 8 then @array@(part_text, {_PRICE})
            when kind = 12 then @array@(part_text, qty_text || '.0', case when cents % 100 = 50 then {_PRICE} else cast(cast(floor((cents + 50) / 100) as bigint) as string) end, flag)
            else @array@(part_text, qty_text || '.0', {_PRICE}, flag) end"""
_REPEATED_CELLS = f"@array@(part_text, qty_text || '.0', {_PRICE}, flag)"
_PRED_CELLS = f"""case when kind = 5 then @array@(part_text, qty_text, {_PRICE}, flag, 'more')
            when kind = 6 then @array@(part_text, qty_text, {_PRICE})
            when kind = 7 then @array@(part_text, {_scaled('cast(qty_text as bigint) * 100001', 100000, 5)}, {_scaled('cents * 100001', 10000000, 7)}, flag)
            when kind = 8 then @array@(part_text, {_scaled('cents * 103', 10000, 4)})
            when kind = 9 then @array@(part_text, ' ' || qty_text, {_PRICE}, lower(flag))
            when kind = 11 then @array@(part_text, qty_text, {_cents('cents * 2')}, flag)
            else @array@(part_text, qty_text, {_PRICE}, flag) end"""
_COPIED_CELLS = f"@array@(part_text, qty_text, {_PRICE}, flag)"
_ADDED_CELLS = "@array@('0', '0', '0.00', 'X')"
_PRED_NUMBER = "case when kind = 0 then 100000 - row_no else row_no end"
_PRED_STAYS = "not (kind = 1 and row_no = n) and kind not in (10, 13)"
_define(
    "result_cells",
    "result_base",
    f"""
    select case_id, 'gold' as side, row_no,
        {_GOLD_CELLS} as cells
    from {{result_base}}
    union all
    select case_id, 'gold' as side, row_no + 100000 as row_no, {_REPEATED_CELLS} as cells
    from {{result_base}} where kind = 4
    union all
    select case_id, 'pred' as side, {_PRED_NUMBER} as row_no,
        {_PRED_CELLS} as cells
    from {{result_base}}
    where {_PRED_STAYS}
    union all
    select case_id, 'pred' as side, row_no + 200000 as row_no, {_COPIED_CELLS} as cells
    from {{result_base}} where kind = 3
    union all
    select case_id, 'pred' as side, 300000 as row_no, {_ADDED_CELLS} as cells
    from {{result_base}} where kind = 2 and row_no = 1
    """,
)
# On Spark, one pass over the rows makes all parts of the union, which would read and sort the rows once each; and rows are numbered by
# case_id itself, so that what is grouped by it next needs no other shuffle. Texts are made after the shuffle.
_define(
    "result_base_by_case",
    "lineitem",
    """
    select case_id, case_id % 14 as kind, row_no, n,
        cast(l_partkey as string) as part_text,
        cast(cast(l_quantity as bigint) as string) as qty_text,
        cast(round(l_extendedprice * 100) as bigint) as cents,
        l_returnflag as flag
    from (select *, row_number() over (partition by case_id order by l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag) as row_no,
            count(*) over (partition by case_id) as n
        from (select l_orderkey as case_id, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag from {lineitem}))
    """,
)
_define(
    "result_cells_at_once",
    "result_base",
    f"""
    select case_id, inline(array_compact(array(
        named_struct('side', 'gold', 'row_no', row_no, 'cells', {_GOLD_CELLS}),
        if(kind = 4, named_struct('side', 'gold', 'row_no', row_no + 100000, 'cells', {_REPEATED_CELLS}), null),
        if({_PRED_STAYS}, named_struct('side', 'pred', 'row_no', {_PRED_NUMBER}, 'cells', {_PRED_CELLS}), null),
        if(kind = 3, named_struct('side', 'pred', 'row_no', row_no + 200000, 'cells', {_COPIED_CELLS}), null),
        if(kind = 2 and row_no = 1, named_struct('side', 'pred', 'row_no', 300000, 'cells', {_ADDED_CELLS}), null))))
    from {{result_base}}
    """,
)
_define(
    "result_cases",
    "result_base",
    """
    select case_id, max(kind) as kind,
        cast(null as string) as gold_error,
        max(case when kind = 13 then 'ERROR: no such column' else null end) as pred_error
    from {result_base} group by case_id
    """,
)


def relations(name: str) -> list[str]:
    """The defined inputs ``name`` needs, dependencies first."""
    if name not in INPUTS:
        return []
    out: list[str] = []
    for dep in INPUTS[name][0]:
        out += [r for r in relations(dep) if r not in out]
    return out + [name]


def _dialect(text: str, side: int) -> str:
    for token, pair in _DIALECT.items():
        text = text.replace(token, pair[side])
    return text


class Inputs:
    """Spark side: attribute access gives a given table or a defined input."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in INPUTS:
                deps, text = INPUTS[_ON_SPARK.get(name, name)]
                self._built[name] = self.spark.sql(_dialect(text, 0), **{d: self.table(d) for d in deps})
            elif name in RAW_TABLES:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def with_inputs(sql: str, extra: dict[str, str] | None = None) -> str:
    """Checking side: prepend the inputs that ``sql`` names as common table expressions."""
    names: list[str] = []
    text = sql + " ".join((extra or {}).values())
    for name in INPUTS:
        if re.search(rf"\b{name}\b", text):
            names += [r for r in relations(name) if r not in names]
    parts = []
    for name in names:
        deps, text = INPUTS[name]
        parts.append(f"{name} as ({_dialect(text, 1).format(**{d: d for d in deps})})")
    parts += [f"{name} as ({body})" for name, body in (extra or {}).items()]
    return (f"with {', '.join(parts)} " if parts else "") + sql

# one model call, task, move and score per event, as the posting builders take them
_define(
    "calls",
    "events",
    """
    select 'x' || cast(event_id as string) as exchange_id, 'p' || cast(user_id % 3 as string) as project_id,
        'v' || cast(event_id % 2 as string) as provider, 'agent-' || cast(user_id % 5 as string) as agent_id,
        'm' || cast(event_id % 3 as string) as model, cast(floor(value) as bigint) as prompt_tokens,
        cast(floor(value / 3) as bigint) as completion_tokens, cast(floor(value * 10) as bigint) as wall_ms,
        case when event_id % 5 = 0 then null else cast(cast(floor(value) as bigint) as double) / 100 end as cost_money,
        'run-' || cast(user_id % 10 as string) as run_id, 't' || cast(event_id as string) as task_id,
        event_type in ('click', 'view') as is_correct, event_type <> 'error' as finished,
        case when event_type = 'error' then 'FAILED' else 'DONE' end as to_state, 'WIP' as from_state,
        case when event_id % 4 = 0 then 'k' || cast(event_id as string) else null end as move_key,
        'accuracy' as metric, round(value, 2) as score, 'e' || cast(event_id as string) as event_key
    from {events}
    """,
)

# investigations, judgements and review sets that belong to the evaluation results
_define(
    "investigations",
    "eval_raw",
    """
    select run_id, question_id, model, event_time, event_id,
        case event_id % 4 when 0 then 'join' when 1 then 'filter' when 2 then 'aggregate' else 'format' end as category,
        case event_id % 5 when 0 then 'GOLD_CORRECT' when 1 then 'PREDICTED_CORRECT' when 2 then 'BOTH_CORRECT'
            when 3 then 'BOTH_WRONG' else 'UNCLEAR' end as verdict,
        case event_id % 3 when 0 then 'KEEP_GOLD' when 1 then 'ADD_TO_PLATINUM' else 'NEEDS_REVIEW' end as recommendation,
        case when event_id % 2 = 0 then 'HIGH' else 'LOW' end as confidence
    from {eval_raw} where level in ('incorrect', 'partial', 'error')
    """,
)
_define(
    "judgements",
    "eval_raw",
    "select run_id, question_id, event_time, event_id, event_id % 2 = 0 as judged_correct from {eval_raw} where level in ('judge_correct', 'incorrect')",
)
_define("reviewed", "eval_raw", "select distinct question_id from {eval_raw} where review = 'approve' and level = 'error'")
_define("second_reference", "eval_raw", "select distinct question_id, db_id from {eval_raw} where review = 'approve' and level = 'hit_limit'")
_define(
    "eval_events",
    "eval_raw",
    """
    select cast(event_id as string) as event_id, run_id, event_time, 'evaluation_result' as kind,
        '{{"question_id":"' || cast(question_id as string) || '","db_id":"' || db_id || '","model":"' || model
        || '","correctness_level":"' || level || '","is_correct":' || case when is_correct then 'true' else 'false' end
        || ',"tool_calls":' || cast(turns as string)
        || ',"duration_ms":' || case when event_id % 6 = 0 then '"soon"' else cast(duration_ms as string) end
        || ',"cost_usd":' || case when event_id % 5 = 0 then 'null' when event_id % 5 = 1 then '"cheap"' else cast(cost_units as string) end
        || '}}' as payload_json
    from {eval_raw}
    """,
)

# predicted and reference answer strings with layout hints, and the rows behind an answer
_define(
    "answer_pairs",
    "orders",
    """
    select o_orderkey as case_id,
        case k when 0 then '[' || a || ', ' || b || ']' when 1 then b || ',' || a when 2 then price || '00' when 3 then '-' || price
            when 4 then lower(a) when 5 then 'n/a' when 6 then a || ':' || price when 7 then '[' || a || ':' || price || ', ' || b || ':7.123]'
            when 8 then 'no' when 9 then a || ', ' || b || ', c' when 10 then '"' || a || '"' when 11 then price else 'wrong' end as answer,
        case k when 0 then a || ', ' || b when 1 then a || ', ' || b when 2 then price when 3 then price
            when 4 then a when 5 then 'Not Applicable' when 6 then a when 7 then '[' || a || ': ' || price || ', ' || b || ': 7.12]'
            when 8 then 'yes' when 9 then 'C, ' || b || ', ' || a when 10 then a when 11 then cents || '.0' else price end as gold,
        o_orderkey % 17 <> 0 as has_sql, o_orderkey % 19 = 0 as failed, o_orderkey % 23 = 0 as hit_limit
    from (select o_orderkey, o_orderkey % 13 as k, o_orderstatus || 'x' as a, substr(o_orderpriority, 3) as b,
            cast(cast(floor(o_totalprice) as bigint) as string) || '.' || lpad(cast(o_orderkey % 100 as string), 2, '7') as price,
            cast(cast(floor(o_totalprice) as bigint) as string) as cents from {orders}) o
    """,
)
_define(
    "answer_guidelines",
    "orders",
    """
    select o_orderkey as case_id, case o_orderkey % 6 when 0 then 'list of values, eg: A, B, C' when 1 then 'comma list'
        when 2 then '[grouping_i: amount_i, ]' when 3 then 'a pair {{scheme}}:{{fee}} rounded to 1 decimals' when 4 then 'rounded to 2 decimals' else null end as guidelines
    from {orders}
    """,
)
_define(
    "answer_rows",
    "result_base answer_guidelines",
    """
    select case_id, row_no, case when case_id % 5 = 0 then @array@(part_text, flag) when case_id % 5 = 1 then @array@(flag, qty_text || '.25')
        when case_id % 5 = 2 then @array@(part_text) when case_id % 5 = 3 then @array@(flag || ':' || qty_text || '.5') else @array@(flag, part_text, qty_text) end as cells
    from {result_base}
    """,
)
_define(
    "sql_pairs",
    "query_log",
    """
    select g.query_id, g.query_text as gold_sql, p.query_text as pred_sql
    from {query_log} g join {query_log} p on cast(g.query_id as bigint) = cast(p.query_id as bigint) - 3
    """,
)
_define(
    "annotations",
    "nation",
    """
    select "table@as@", "column@as@", case n_nationkey % 7 when 0 then '' when 1 then 'the ' || replace(coalesce("column@as@", 'whole table'), '_', ' ') || ' column'
        when 2 then repeat('long ', 60) else 'Set by ' || n_name end as annotation
    from (select n_nationkey, n_name, case n_nationkey % 5 when 4 then 'nowhere' when 3 then 'documents' when 2 then 'lineitem' else 'orders' end as "table@as@",
        case n_nationkey % 6 when 2 then 'o_missing' when 3 then null else case n_nationkey % 5
            when 3 then case n_nationkey % 6 when 0 then 'doc_id' when 1 then 'lang' when 4 then 'n_chars' else 'source' end
            when 2 then case n_nationkey % 6 when 0 then 'l_orderkey' when 1 then 'l_returnflag' when 4 then 'l_tax' else 'l_shipdate' end
            else case n_nationkey % 6 when 0 then 'o_orderkey' when 1 then 'o_orderstatus' when 4 then 'o_totalprice' else 'o_custkey' end end end as "column@as@"
        from {nation}) x
    """.replace('"table@as@"', "@q@table@q@").replace('"column@as@"', "@q@column@q@"),
)
_DIALECT["@q@table@q@"] = ("`table`", '"table"')
_DIALECT["@q@column@q@"] = ("`column`", '"column"')

# a text as a JSON string
_DIALECT["@json("] = ("regexp_extract(to_json(named_struct('v', ", "cast(to_json(")
_DIALECT[")json@"] = (")), '(?s)^.....(.*).$', 1)", ") as varchar)")

# messages of recorded conversations in two dialects
_define(
    "trace_messages",
    "conversations",
    """
    select conv_id as trace_id, turn as seq, case when conv_id % 2 = 0 then
            case when role = 'assistant' then '{{"role":"assistant","thinking":' || @json(case when turn % 3 = 1 then 'hm ' || body else '' end)json@ || ',"content":'
                    || @json(case when turn % 4 = 3 then 'FINAL_SQL: ' else '' end || body)json@ || ',"tool_calls":[' || case when turn % 4 = 1 then
                    '{{"id":"c' || cast(turn as string) || '","function":{{"name":"run_sql","arguments":"{{}}"}}}},{{"id":"d' || cast(turn as string) || '","name":"look","arguments":"{{}}"}}' else '' end || ']}}'
                when role = 'user' and turn % 4 = 2 then '{{"role":"tool","tool_call_id":"' || case when conv_id % 4 = 0 then 'c' || cast(turn - 1 as string) else '' end || '","result":' || @json(body)json@ || '}}'
                else '{{"role":"' || role || '","content":[{{"type":"text","text":' || @json(body)json@ || '}}]}}' end
        else case when role = 'assistant' then case turn % 4 when 1 then '{{"type":"function_call","call_id":"f' || cast(turn as string) || '","name":"query","arguments":"{{}}"}}'
                else '{{"type":"message","role":"assistant","content":' || @json(body)json@ || '}}' end
            when role = 'user' and turn % 4 = 2 then '{{"type":"function_call_output","call_id":"f' || cast(turn - 1 as string) || '","output":' || @json(body)json@ || '}}'
            else '{{"role":"' || role || '","content":' || @json(body)json@ || '}}' end
        end as message
    from (select *, coalesce(text, '') as body from {conversations}) c
    """,
)
_define(
    "responses",
    "conversations",
    """
    select conv_id, turn, case when turn % 3 = 0 then '<thinking>A, b</thinking> <guess>' || role || ', w2 ,W3, w4</guess><confidence> high </confidence>'
        when turn % 3 = 1 then 'I say ' || upper(role) || ', TWO, THREE, FOUR' else role || ',x' end as response,
        '**Question:** what is ' || role || '? **Hints:** see ' || coalesce(text, '') || case when turn % 2 = 0 then '

Hints define things' else '' end as prompt,
        case when turn % 2 = 0 then 'FINAL_SQL:
```sql
select ' || cast(turn as string) || '
```' else text end as answer,
        case turn % 3 when 0 then 'x ```json {{"verdict":"GOLD_CORRECT","confidence":"HIGH","reasoning":"' || role || '","recommendation":"KEEP_GOLD"}} ``` y'
            when 1 then 'see {{"verdict":"BOTH_WRONG","confidence":"LOW","reasoning":"r","recommendation":"NEEDS_REVIEW","more":{{"a":1}}}} end' else 'no json' end as judgement
    from {conversations}
    """,
)
_define(
    "guesses",
    "events",
    """
    select user_id as run_id, event_id % 20 as puzzle_id, event_id as guess_index, '<guess>' || case event_id % 9
        when 6 then 'W' || cast(b as string) || ', W' || cast(b + 1 as string) || ', W' || cast(b + 2 as string) || ', W' || cast((b + 4) % 16 as string)
        when 7 then 'W0, W5, W10, W15' when 8 then 'W1, W2'
        else 'W' || cast(b as string) || ', w' || cast(b + 1 as string) || ', W' || cast(b + 2 as string) || ', W' || cast(b + 3 as string) end || '</guess>' as response
    from (select *, (cast(floor(value) as bigint) % 4) * 4 as b from {events}) e
    """,
)
_define(
    "puzzles",
    "events",
    """
    select distinct event_id % 20 as puzzle_id, @array@(@array@('W0', 'W1', 'W2', 'W3'), @array@('w4', 'W5', 'W6', 'W7'), @array@('W8', 'W9', 'W10', 'W11'),
        @array@('W12', 'W13', 'W14', 'W15')) as groups from {events}
    """,
)
_define(
    "schema_columns",
    "customer",
    "select cast(c_nationkey as bigint) as db_id, c_custkey as column_index, 'T' || cast(c_custkey % 9 as string) as table_name, c_name as column_name from {customer}",
)
_define(
    "schema_keys",
    "orders",
    "select o_orderkey % 25 as db_id, o_custkey as from_index, (o_custkey * 7) % 1600 as to_index from {orders}",
)
