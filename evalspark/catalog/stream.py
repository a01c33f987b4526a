"""Registered queries of the streaming family: the stream runs to its end, its whole output is returned.

Windows, sessions and prompts that are still open are in the results as upserts. Moves and timeouts of tasks follow the watermark,
which a last event without a move carries past all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.catalog.inputs import Inputs
from evalspark.catalog.ledger import _D
from evalspark.catalog.registry import Registry
from evalspark.operators.ledger import dedupe_latest
from evalspark.session import fresh_dir, materialize
from evalspark.streaming import ledger_streams as S


def _source(t: Inputs, df: DataFrame) -> DataFrame:
    path = fresh_dir(t.spark, "stream-in")
    df.write.parquet(path)
    return S.read_stream(t.spark, path, df.schema)


def _events(t: Inputs) -> DataFrame:
    # read for the time span and for each half
    return materialize(dedupe_latest(t.ledger_events, "event_id", ["ingest_time"]), "stream-events")


def _in_two(events: DataFrame, *closing: DataFrame) -> list[DataFrame]:
    """Each half of the time, and what closes it: parts that arrive one after the other."""
    span = events.agg(F.min("event_time").alias("a"), F.max("event_time").alias("b"))
    middle = span.select(F.timestamp_seconds((F.unix_timestamp("a") + F.unix_timestamp("b")) / 2)).scalar()
    return [events.filter(F.col("event_time") < middle), events.filter(F.col("event_time") >= middle), *closing]


def _arriving(t: Inputs, parts: list[DataFrame], change: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, str, str], None]) -> tuple[str, DataFrame]:
    """The output folder and form of a stream that goes on from its checkpoint with every part, a batch of any number of files."""
    path, out, state = (fresh_dir(t.spark, f"stream-{name}") for name in ("in", "out", "state"))
    for part in parts:
        part.write.mode("append").parquet(path)
        changed = change(S.read_stream(t.spark, path, part.schema))
        write(changed, out, state)
    return out, changed


def _appended(t: Inputs, df: DataFrame) -> DataFrame:
    out = fresh_dir(t.spark, "stream-out")
    S.write_append(df, out, fresh_dir(t.spark, "stream-state"))
    return t.spark.read.schema(df.schema).parquet(out)


def _appended_parts(t: Inputs, parts: list[DataFrame], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out, df = _arriving(t, parts, change, S.write_append)
    return t.spark.read.schema(df.schema).parquet(out)


def _upserted(t: Inputs, parts: list[DataFrame], change: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    out, df = _arriving(t, parts, change, S.write_upserts)
    return S.read_upserts(t.spark, out, df.schema, keys)


def _closing(events: DataFrame, days: int) -> DataFrame:
    """An event of no task, far behind all others."""
    late = events.agg((F.max("event_time") + F.expr(f"interval {days} days")).alias("event_time"))
    return late.select(*[
        (F.col("event_time") if f.name == "event_time" else F.lit("heartbeat") if f.name == "kind" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in events.schema.fields
    ])


_TASK_MOVES = "select actor_task_id as task_id, event_id, event_time, payload_json->>'$.from' as f, payload_json->>'$.to' as s from deduped where kind = 'state_move'"
# a pause of two days ends a run of moves
_TASK_RUNS = """
select *, sum(fresh) over (partition by task_id order by event_time, event_id rows unbounded preceding) as run from (
    select *, case when event_time - lag(event_time) over (partition by task_id order by event_time, event_id) >= interval 2 day then 1 else 0 end as fresh from m)
"""
_TASK_VIEWS = """
select *, lag(s) over w as prev, coalesce(max(case when s in ('DONE', 'FAILED') then 1 else 0 end) over (partition by task_id, run order by event_time, event_id
    rows between unbounded preceding and 1 preceding), 0) = 1 as ended_before
from g window w as (partition by task_id, run order by event_time, event_id)
"""


def register(r: Registry) -> None:
    def ingest(t: Inputs) -> DataFrame:
        target = fresh_dir(t.spark, "stream-table")
        hour = F.hour("event_time")
        # the second stream brings half of the ids again
        for part in (hour < 14, hour >= 10):
            S.stream_ingest(_source(t, t.ledger_events.filter(part)), target, fresh_dir(t.spark, "stream-state"))
        return t.spark.read.schema(t.ledger_events.schema).parquet(target).select(t.ledger_events.columns)

    r.add("stream_ingest", ingest, "select * from deduped", extra=_D)
    r.add(
        "stream_dedupe",
        lambda t: _appended(t, S.stream_dedupe(_source(t, t.ledger_events)).select("event_id", "kind")),
        "select event_id, kind from deduped",
        extra=_D,
    )

    def balance(t: Inputs) -> DataFrame:
        out = fresh_dir(t.spark, "stream-out")
        df = S.stream_trial_balance(_source(t, t.ledger_postings))
        S.write_complete(df, out, fresh_dir(t.spark, "stream-state"))
        return S.violations(t.spark.read.schema(df.schema).parquet(out))

    r.add(
        "stream_trial_balance",
        balance,
        "select account_type, unit, sum(delta_numeric) as net, count(*) as posting_count from ledger_postings group by 1, 2 having abs(sum(delta_numeric)) > 1e-4",
        doubles="net",
    )
    window = ["window_start", "window_end", "kind"]
    r.add(
        "stream_kind_windows",
        lambda t: _upserted(t, _in_two(_events(t)), S.stream_kind_windows, window),
        """
        select date_trunc('day', event_time)::timestamp as window_start, date_trunc('day', event_time)::timestamp + interval 1 day as window_end, kind, count(*) as n
        from deduped group by 1, 2, 3
        """,
        extra=_D,
    )
    r.add(
        "stream_kind_windows_sliding",
        lambda t: _upserted(t, _in_two(_events(t)), lambda df: S.stream_kind_windows(df, "1 hour", "15 minutes"), window),
        """
        select time_bucket(interval 15 minute, event_time) - interval 15 minute * k as window_start,
            time_bucket(interval 15 minute, event_time) - interval 15 minute * k + interval 1 hour as window_end, kind, count(*) as n
        from deduped, (select unnest([0, 1, 2, 3]) as k) group by 1, 2, 3
        """,
        extra=_D,
    )
    r.add(
        "stream_sessions",
        lambda t: S.sessions(_upserted(t, _in_two(_events(t)), lambda df: S.stream_sessions(df, "actor_task_id", "3 hours"), ["actor_task_id", "session_start"])),
        """
        select actor_task_id, min(event_time) as session_start, max(event_time) + interval 3 hour as session_end, count(*) as events from (
            select *, sum(fresh) over (partition by actor_task_id order by event_time, event_id rows unbounded preceding) as no from (
                select *, case when event_time - lag(event_time) over (partition by actor_task_id order by event_time, event_id) < interval 3 hour then 0 else 1 end as fresh from deduped))
            group by actor_task_id, no
        """,
        extra=_D,
    )

    r.add(
        "stream_exchange_join",
        lambda t: S.exchanges(_appended_parts(t, _in_two(_events(t)), S.stream_exchange_join)),
        """
        select p.x as exchange_id, p.event_id as prompt_id, p.event_time as prompt_time, c.event_id as completion_id, c.event_time as completion_time
        from (select *, payload_json->>'$.exchange_id' as x from deduped where kind = 'model_prompt') p
        left join (select *, payload_json->>'$.exchange_id' as x from deduped where kind = 'model_completion') c
            on p.x = c.x and c.event_time >= p.event_time and c.event_time <= p.event_time + interval 2 hour
        """,
        extra=_D,
    )

    def tasks(t: Inputs) -> DataFrame:
        events = _events(t)
        # the first closing event has all moves judged, the second one fires the timers that these set
        return _appended_parts(t, _in_two(events, _closing(events, 30), _closing(events, 60)), S.stream_task_state)

    r.add(
        "stream_task_state",
        tasks,
        """
        select task_id, event_id, event_time, f as from_state, s as to_state, case when ended_before then 'after_end' when prev is null and f <> 'NEW' then 'wrong_start'
            when prev is not null and f <> prev then 'broken_chain' else 'legal' end as verdict from v
        union all
        select task_id, null, null, arg_max(s, (event_time, event_id)), null, 'timeout' from g group by task_id, run having not bool_or(s in ('DONE', 'FAILED'))
        """,
        extra={**_D, "m": _TASK_MOVES, "g": _TASK_RUNS, "v": _TASK_VIEWS},
    )
    r.add(
        "late_data_report",
        lambda t: S.late_data_report(t.ledger_events),
        """
        select case when d < 60 then '<1m' when d < 120 then '1-2m' when d < 180 then '2-3m' else '>=3m' end as delay_bucket, count(*) as events, count(*) filter (d > 60) as late
        from (select epoch(ingest_time) - epoch(event_time) as d from ledger_events) group by 1
        """,
    )
