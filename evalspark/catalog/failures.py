"""Registered queries of the failure mining family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.evaluation import _OUTCOME
from evalspark.catalog.registry import Registry
from evalspark.operators import failures as I

_B = {"bucketed": f"select *, {_OUTCOME} as outcome from eval_results"}
_SHAPES = """
select case_id, count(*) filter (side = 'gold') as g, count(*) filter (side = 'pred') as p,
    arg_min(len(cells), row_no) filter (side = 'gold') as gw, arg_min(len(cells), row_no) filter (side = 'pred') as pw,
    arg_min(cells[1], row_no) filter (side = 'gold') as gc, arg_min(cells[1], row_no) filter (side = 'pred') as pc
from result_cells group by 1
"""


def _type(c: str) -> str:
    return (
        f"case when {c} is null then 'null' when regexp_full_match({c}, '[+-]?[0-9]+') then 'int' "
        f"when regexp_full_match({c}, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') then 'float' else 'text' end"
    )


def register(r: Registry) -> None:
    r.add(
        "outcome_bucket",
        lambda t: I.outcome_counts(t.eval_results),
        "select outcome, count(*) as n, count(*) * cast(100 as double) / (select count(*) from bucketed) as pct from bucketed group by 1",
        doubles="pct",
        extra=_B,
    )
    r.add(
        "partial_reasons",
        lambda t: I.partial_reasons(t.eval_results),
        "select partial_reason as reason, count(*) as n from bucketed where outcome = 'partial' group by 1",
        extra=_B,
    )
    r.add(
        "partial_reason_types",
        lambda t: I.partial_reasons(t.eval_results, by_type=True),
        "select split_part(partial_reason, ':', 1) as reason, count(*) as n from bucketed where outcome = 'partial' group by 1",
        extra=_B,
    )
    r.add(
        "error_types",
        lambda t: I.error_types(t.eval_results),
        """
        select error_type, n, cast(sample as integer) as sample, question_id, replace(error, chr(10), ' ') as preview from (
            select *, count(*) over (partition by error_type) as n, row_number() over (partition by error_type order by event_id) as sample from (
                select *, case when contains(error, 'Binder Error') then 'Binder Error' when contains(error, 'Catalog Error') then 'Catalog Error'
                    when contains(error, 'Parser Error') then 'Parser Error' when contains(lower(error), 'timeout') then 'Timeout' else 'Other' end as error_type
                from bucketed where outcome = 'error')) where sample <= 2
        """,
        extra=_B,
    )
    r.add(
        "shape_mismatch",
        lambda t: I.shape_mismatch(t.result_cells, t.result_cases.filter("kind <> 0")),
        """
        select case when gw <> pw then 'column_count' when g <> p then 'row_count' else 'value' end as mismatch, count(*) as n
        from shapes where g > 0 and p > 0 and case_id in (select case_id from result_cases where kind <> 0) group by 1
        """,
        extra={"shapes": _SHAPES},
    )
    r.add(
        "cardinality_mismatch",
        lambda t: I.cardinality_mismatch(t.result_cells),
        f"""
        select case_id, case when g > 1 and p = 1 then 'expected_list_got_single' when g = 1 and p > 1 then 'expected_single_got_list' end as cardinality,
            {_type('gc')} <> {_type('pc')} as type_mismatch from shapes where g > 0 and p > 0
        """,
        extra={"shapes": _SHAPES},
    )
    r.add(
        "keyword_fail_rate",
        lambda t: I.keyword_fail_rate(t.eval_results),
        "select keyword, wrong, correct, wrong * cast(100 as double) / (wrong + correct) as fail_rate from (select k as keyword, "
        "count(*) filter (outcome = 'wrong') as wrong, count(*) filter (outcome = 'correct') as correct from bucketed, "
        f"(select unnest({I.KEYWORDS}) as k) where contains(lower(question), k) group by 1) where wrong + correct > 5",
        doubles="fail_rate",
        extra=_B,
    )
    classes = " ".join(
        "when " + " or ".join(f"contains(q, '{w}')" for w in words) + f" then '{name}'" for name, words in I.QUESTION_CLASSES
    )
    r.add(
        "question_category",
        lambda t: I.question_categories(t.eval_results),
        f"select case {classes} else 'other_errors' end as category, count(*) as n from (select lower(question) as q from bucketed where outcome = 'wrong') group by 1",
        extra=_B,
    )
    r.add(
        "question_category_documents",
        lambda t: t.documents.groupBy(I.question_category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n")),
        f"select case {classes} else 'other_errors' end as category, count(*) as n from (select lower(text) as q from documents) group by 1",
    )
    r.add(
        "top_failures_by_group",
        lambda t: I.top_failures_by_group(t.eval_results, ["db_id"], 5),
        "select db_id, event_id, question_id, question, cast(rk as integer) as rank from (select *, row_number() over (partition by db_id order by event_id) as rk "
        "from bucketed where outcome = 'wrong') where rk <= 5",
        extra=_B,
    )
