"""Registered queries of the run analytics family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.inputs import Inputs
from evalspark.catalog.ledger import _D
from evalspark.catalog.registry import Registry
from evalspark.operators import ledger as L
from evalspark.operators import runs as C

_SUMMARY = """
select h.*, coalesce(s.cost, 0) as cost, coalesce(s.latency_ms, 0) as latency_ms, coalesce(s.utility, 0) as utility,
    coalesce(s.ok, true) as invariant_ok
from (select run_id, min(event_time) as first_time, max(event_time) as last_time, count(*) as event_count,
        count(distinct kind) as kind_count, min(project_id) as project from deduped group by 1) h
left join (select run_id, sum(flow) filter (account_type in ('truth.money', 'resource.money')) as cost,
        sum(flow) filter (account_type in ('truth.time', 'resource.time_ms')) as latency_ms,
        sum(flow) filter (account_type in ('truth.utility', 'value.utility')) as utility, bool_and(abs(net) <= 1e-4) as ok
    from (select e.run_id, account_type, unit, sum(delta_numeric) as net,
            sum(case when delta_numeric > 0 then delta_numeric else 0 end) as flow
          from ledger_postings p join deduped e on p.event_id = e.event_id group by 1, 2, 3) group by 1) s
on h.run_id is not distinct from s.run_id
"""
_MATRIX = """
select run_id, question_id, is_correct from (
    select run_id, payload_json->>'$.question_id' as question_id, cast(payload_json->>'$.is_correct' as boolean) as is_correct,
        row_number() over (partition by run_id, payload_json->>'$.question_id' order by event_time desc, event_id desc) as rn
    from deduped where kind = 'evaluation_result') where rn = 1
"""
_TRANS = """
select run_id, question_id, is_correct, prev, case when prev is not null and prev <> is_correct then case when is_correct then 'prog' else 'regr' end end as kind
from (select m.run_id, question_id, coalesce(is_correct, false) as is_correct,
        lag(coalesce(is_correct, false)) over (partition by question_id order by first_time, coalesce(m.run_id, '')) as prev
      from matrix m join (select run_id, min(event_time) as first_time from deduped group by 1) h on m.run_id is not distinct from h.run_id)
"""
_S = {**_D, "summary": _SUMMARY}
_M = {**_D, "matrix": _MATRIX, "trans": _TRANS}


def _events(t: Inputs):
    return L.dedupe_latest(t.ledger_events, "event_id", ["ingest_time"])


def _summary(t: Inputs):
    return C.run_summary(_events(t), t.ledger_postings)


def _transitions(t: Inputs):
    events = _events(t)
    runs = events.groupBy("run_id").agg(F.min("event_time").alias("first_time"))
    return C.matrix_transitions(C.eval_matrix(events), runs)


def register(r: Registry) -> None:
    r.add(
        "recent_run_ids",
        lambda t: C.recent_run_ids(_events(t)),
        "select run_id, max(event_time) as last_time from deduped group by 1",
        extra=_D,
    )
    r.add(
        "latest_run_id",
        lambda t: C.latest_run_id(_events(t)),
        "select run_id, max(event_time) as last_time from deduped group by 1 order by 2 desc, 1 nulls last limit 1",
        extra=_D,
    )
    r.add(
        "run_scope_filter",
        lambda t: C.run_scope_filter(_events(t), ["run-1", "run-4", None]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")),
        "select run_id, count(*) as n from deduped where run_id in ('run-1', 'run-4') or run_id is null group by 1",
        extra=_D,
    )
    r.add("run_summary", _summary, "select * from summary", doubles="cost latency_ms utility", digits=2, extra=_S)
    r.add(
        "events_for_run",
        lambda t: C.events_for_run(_events(t), None),
        "select event_time, event_id, kind, actor_agent_id, actor_task_id, idempotency_key, payload_json from deduped where run_id is null",
        extra=_D,
    )
    r.add("kind_counts", lambda t: C.kind_counts(_events(t)), "select kind, count(*) as count from deduped group by 1", extra=_D)
    r.add(
        "kind_counts_by_run",
        lambda t: C.kind_counts(_events(t), by_run=True),
        "select run_id, kind, count(*) as count from deduped group by 1, 2",
        extra=_D,
    )
    kinds = ["model_prompt", "model_completion", "state_move", "evaluation_result", "task_failed"]
    r.add(
        "kind_counts_wide",
        lambda t: C.kind_counts_wide(_events(t), kinds),
        "select run_id, " + ", ".join(f"count(*) filter (kind = '{k}') as {k}" for k in kinds) + " from deduped group by 1",
        extra=_D,
    )
    r.add("eval_matrix", lambda t: C.eval_matrix(_events(t)), "select * from matrix", extra=_M)
    r.add("matrix_transitions", _transitions, "select * from trans", extra=_M)
    r.add(
        "matrix_volatility",
        lambda t: C.matrix_volatility(_transitions(t)),
        """
        select question_id, count(kind) as flips from trans group by 1
        order by 2 desc, case when regexp_matches(question_id, '^[0-9]+$') then cast(question_id as bigint) end nulls last, 1
        """,
        extra=_M,
    )
    shown = [f"run-{i}" for i in range(10)] + [None]
    r.add(
        "matrix_pivot",
        lambda t: C.matrix_pivot(C.eval_matrix(_events(t)), shown),
        "select question_id, "
        + ", ".join(
            f"bool_or(coalesce(is_correct, false)) filter (run_id is not distinct from {'null' if s is None else repr(s)}) as {'none' if s is None else s.replace('-', '_')}"
            for s in shown
        ).replace(" as none", ' as "none"')
        + " from matrix group by 1",
        extra=_M,
    )
    deltas = [f"{m} - lag({m}) over (partition by project order by first_time, coalesce(run_id, '')) as {m}_delta" for m in ("cost", "latency_ms", "utility")]
    r.add(
        "trend_series",
        lambda t: C.trend_series(_summary(t)),
        f"select project, run_id, first_time, cost, latency_ms, utility, {', '.join(deltas)} from summary",
        doubles="cost latency_ms utility cost_delta latency_ms_delta utility_delta",
        digits=2,
        extra=_S,
    )
    r.add(
        "dashboard_totals",
        lambda t: C.dashboard_totals(_summary(t), t.ledger_postings),
        "select count(*) as runs, sum(event_count) as events, sum(cost) as cost, sum(utility) as utility, "
        "(select count(*) from (select 1 from ledger_postings group by account_type, unit having abs(sum(delta_numeric)) > 1e-4)) as violations from summary",
        doubles="cost utility",
        longs="events",
        digits=2,
        extra=_S,
    )
    r.add(
        "has_kind",
        lambda t: C.has_kind(_events(t), "learn_question"),
        "select run_id, count(*) filter (kind = 'learn_question') > 0 as present from deduped group by 1",
        extra=_D,
    )
