"""Registered queries of the result comparison and answer scoring family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.inputs import Inputs
from evalspark.catalog.registry import Registry
from evalspark.functions import cells as X
from evalspark.operators import answers as A
from evalspark.operators import compare as G

_NUM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_NORM = f"""
select *, list_transform(w, lambda x: case when x in ('true', 'yes') then cast(1 as double) when x in ('false', 'no') then cast(0 as double)
        when regexp_full_match(x, '{_NUM}') then try_cast(x as double) end) as nums,
    list_transform(w, lambda x: case when x in ('true', 'yes', 'false', 'no') or regexp_full_match(x, '{_NUM}') then null else x end) as txts,
    list_transform(cells, lambda c: case when regexp_full_match(trim(c), '{_NUM}') then case when contains(trim(c), '.')
        then length(regexp_replace(split_part(trim(c), '.', 2), '0+$', '')) else 0 end end) as places
from (select *, list_transform(cells, lambda c: lower(trim(c))) as w from result_cells)
"""


def _equal(a: str, b: str, i: str, j: str) -> str:
    x, y = f"{a}.nums[{i}]", f"{b}.nums[{j}]"
    return (
        f"case when {x} is not null and {y} is not null then case when {x} = 0 and {y} = 0 then true when {x} = 0 or {y} = 0 "
        f"then abs({x} - {y}) < 1e-4 else abs({x} - {y}) / greatest(abs({x}), abs({y})) < 1e-4 end "
        f"else {x} is null and {y} is null and {a}.txts[{i}] is not distinct from {b}.txts[{j}] end"
    )


def _adaptive(a: str, b: str, i: str) -> str:
    def rounded(t: str) -> str:
        return f"round_even({t}.nums[{i}] * pow(10, {a}.places[{i}]), 0)"

    return f"(coalesce({rounded(a)} = {rounded(b)}, false) or {_equal(a, b, i, i)})"


def _all(a: str, b: str, expr: str) -> str:
    return f"(len({a}.nums) = len({b}.nums) and list_aggregate(list_transform(range(1, len({a}.nums) + 1), lambda i: {expr}), 'bool_and'))"


def _subset(a: str, b: str) -> str:
    some = f"list_aggregate(list_transform(range(1, len({b}.nums) + 1), lambda j: {_equal(a, b, 'i', 'j')}), 'bool_or')"
    return f"list_aggregate(list_transform(range(1, len({a}.nums) + 1), lambda i: {some}), 'bool_and')"


# brute force over all pairs of a case, which are few in the test tables
_CROSS = f"""
select g.case_id, g.row_no as gr, p.row_no as pr, {_all('g', 'p', _adaptive('g', 'p', 'i'))} as gp, {_all('p', 'g', _adaptive('p', 'g', 'i'))} as pg
from (select * from norm where side = 'gold') g join (select * from norm where side = 'pred') p on g.case_id = p.case_id
"""
_STATS = """
select case_id, count(*) filter (side = 'gold') as n_gold, count(*) filter (side = 'pred') as n_pred,
    coalesce(max(len(cells)) filter (side = 'gold'), 0) as w_gold, coalesce(max(len(cells)) filter (side = 'pred'), 0) as w_pred,
    count(distinct struct_pack(a := nums, b := txts)) filter (side = 'gold') as d_gold,
    count(distinct struct_pack(a := nums, b := txts)) filter (side = 'pred') as d_pred
from norm group by 1
"""
_COMMON = """
select case_id, count(*) as common from (select case_id, nums, txts from norm group by 1, 2, 3 having bool_or(side = 'gold') and bool_or(side = 'pred')) group by 1
"""
_GOLD_HIT = "select case_id, bool_and(hit) as gold_hit from (select case_id, gr, bool_or(gp) as hit from pairs group by 1, 2) group by 1"
_PRED_HIT = "select case_id, bool_and(hit) as pred_hit, bool_and(hit2) as pred_hit2 from (select case_id, pr, bool_or(pg) as hit, bool_or(gp) as hit2 from pairs group by 1, 2) group by 1"
_COLS = f"""
select g.case_id, bool_and(case when len(p.nums) < len(g.nums) then {_subset('p', 'g')} else {_subset('g', 'p')} end) as subset
from (select *, row_number() over (partition by case_id order by nums, txts, row_no) as rk from norm where side = 'gold') g
join (select *, row_number() over (partition by case_id order by nums, txts, row_no) as rk from norm where side = 'pred') p
    on g.case_id = p.case_id and g.rk = p.rk where len(g.nums) <> len(p.nums) group by 1
"""
_CLOSE = """
select g.case_id, len(g.nums) = len(p.nums) and list_aggregate(list_transform(range(1, len(g.nums) + 1), lambda i: coalesce(g.places[i] is not null
    and p.places[i] is not null and g.nums[i] <> 0 and abs(g.nums[i] - p.nums[i]) / abs(g.nums[i]) < 0.05, false)), 'bool_and') as is_close
from (select * from norm where side = 'gold') g join (select * from norm where side = 'pred') p on g.case_id = p.case_id
where g.case_id in (select case_id from stats where n_gold = 1 and n_pred = 1)
"""
_BASE = {"norm": _NORM, "stats": _STATS, "shared_rows": _COMMON}
_MISSING = "'missing_columns:' || (w_gold - w_pred)"
_FULL = {
    **_BASE,
    "pairs": _CROSS,
    "gold_found": _GOLD_HIT,
    "pred_found": _PRED_HIT,
    "cols": _COLS,
    "near": _CLOSE,
    "found": """
        select c.case_id, c.gold_error, c.pred_error, coalesce(n_gold, 0) as n_gold, coalesce(n_pred, 0) as n_pred, w_gold, w_pred, d_gold, d_pred,
            coalesce(common, 0) as common, gold_hit, pred_hit, pred_hit2, subset, is_close
        from result_cases c left join stats using (case_id) left join shared_rows using (case_id) left join gold_found using (case_id)
        left join pred_found using (case_id) left join cols using (case_id) left join near using (case_id)
    """,
}
_VERDICT = """
select case_id, split_part(v, '|', 1) as level, nullif(split_part(v, '|', 2), '') as reason from (select case_id,
    case when coalesce(contains(gold_error, 'ERROR'), false) then 'error|gold_query_error'
        when coalesce(contains(pred_error, 'ERROR'), false) then 'error|predicted_query_error'
        when n_gold = 0 and n_pred = 0 then 'correct|' when n_gold = 0 or n_pred = 0 then 'incorrect|empty_result'
        when w_gold = w_pred and n_gold = n_pred and gold_hit and pred_hit2 then 'correct|'
        when w_pred < w_gold and n_gold = n_pred and subset then 'partial|missing_columns:' || (w_gold - w_pred)
        when w_pred > w_gold and n_gold = n_pred and subset then 'partial|extra_columns:' || (w_pred - w_gold)
        when w_gold = w_pred and n_pred = 1 and n_gold > 1 and d_gold = 1 and common = 1 then 'partial|aggregated_equivalent:' || n_gold || '_to_1'
        when w_gold = w_pred and n_pred < n_gold and d_gold < n_gold and d_gold = d_pred and common = d_gold
            then 'partial|implicit_distinct:' || (n_gold - d_gold) || '_duplicates_removed'
        when w_gold = w_pred and n_pred > n_gold and d_pred < n_pred and d_gold = d_pred and common = d_gold
            then 'partial|extra_duplicates:' || (n_pred - d_pred) || '_duplicates_in_predicted'
        when w_gold = w_pred and n_pred < n_gold and pred_hit then 'incorrect|missing_rows:' || (n_gold - n_pred)
        when w_gold = w_pred and n_pred > n_gold and gold_hit then 'partial|extra_rows:' || (n_pred - n_gold)
        when coalesce(is_close, false) then 'partial|values_close_not_exact' else 'incorrect|' end as v from found)
"""
_SIMPLE = """
select c.case_id, kind is null as matches, kind as mismatch_type from (
    select c.case_id, case when c.gold_error is not null or c.pred_error is not null then 'error' when coalesce(n_gold, 0) <> coalesce(n_pred, 0) then 'row_count_mismatch'
        when d_gold <> coalesce(common, 0) or d_pred <> coalesce(common, 0) then 'value_mismatch' end as kind
    from result_cases c left join stats using (case_id) left join shared_rows using (case_id)) c
"""
# pairs by row number, for the cell level functions
_ALIGNED = """
(select * from norm where side = 'gold') g join (select * from norm where side = 'pred') p on g.case_id = p.case_id and g.row_no = p.row_no
"""
_P_TRIM = "regexp_replace(trim({c}), '^\"+|\"+$', '', 'g')"


def _aligned(t: Inputs):
    norm = G.normalized(t.result_cells)
    gold = norm.filter("side = 'gold'").select("case_id", "row_no", F.col("row").alias("a"), F.col("places").alias("places"))
    pred = norm.filter("side = 'pred'").select("case_id", "row_no", F.col("row").alias("b"))
    return gold.join(pred, ["case_id", "row_no"])


def _cell_query(t: Inputs, equal):
    zipped = F.arrays_zip(F.col("a").alias("a"), F.col("b").alias("b"), F.col("places").alias("p"))
    rows = _aligned(t).filter(F.size("a") == F.size("b")).select("case_id", "row_no", F.posexplode(zipped).alias("pos", "c"))
    return rows.select("case_id", "row_no", "pos", equal(F.col("c")).alias("is_equal"))


def register(r: Registry) -> None:
    r.add(
        "normalize_value",
        lambda t: G.normalized(t.result_cells)
        .select("case_id", "side", "row_no", F.posexplode("row").alias("pos", "c"))
        .select("case_id", "side", "row_no", "pos", "c.num", "c.txt"),
        "select case_id, side, row_no, cast(i - 1 as integer) as pos, nums[i] as num, txts[i] as txt from norm, lateral (select unnest(range(1, len(nums) + 1)) as i)",
        extra={"norm": _NORM},
    )
    r.add(
        "normalize_row",
        lambda t: G.normalized(t.result_cells).groupBy("case_id", "side").agg(F.count_distinct("row").alias("distinct_rows")),
        "select case_id, side, count(distinct struct_pack(a := nums, b := txts)) as distinct_rows from norm group by 1, 2",
        extra={"norm": _NORM},
    )
    r.add(
        "decimal_places",
        lambda t: G.normalized(t.result_cells)
        .select("side", F.explode("places").alias("decimals"))
        .groupBy("decimals", "side")
        .agg(F.count(F.lit(1)).alias("n")),
        "select cast(d as integer) as decimals, side, count(*) as n from (select side, unnest(places) as d from norm) group by 1, 2",
        extra={"norm": _NORM},
    )
    aligned_cells = f"select g.case_id, g.row_no, cast(i - 1 as integer) as pos, {{expr}} as is_equal from {_ALIGNED}, lateral (select unnest(range(1, len(g.nums) + 1)) as i) where len(g.nums) = len(p.nums)"
    r.add(
        "values_equal_tolerant",
        lambda t: _cell_query(t, lambda c: X.values_equal(c["a"], c["b"])),
        aligned_cells.format(expr=_equal("g", "p", "i", "i")),
        extra={"norm": _NORM},
    )
    r.add(
        "values_equal_adaptive",
        lambda t: _cell_query(t, lambda c: X.values_equal_adaptive(c["a"], c["b"], c["p"])),
        aligned_cells.format(expr=_adaptive("g", "p", "i")),
        extra={"norm": _NORM},
    )
    r.add(
        "rows_equal",
        lambda t: _aligned(t).select("case_id", "row_no", X.rows_equal(F.col("a"), F.col("b")).alias("is_equal")),
        f"select g.case_id, g.row_no, {_all('g', 'p', _equal('g', 'p', 'i', 'i'))} as is_equal from {_ALIGNED}",
        extra={"norm": _NORM},
    )
    r.add(
        "rows_equal_adaptive",
        lambda t: _aligned(t).select(
            "case_id", "row_no", X.rows_equal_adaptive(F.col("a"), F.col("b"), F.col("places")).alias("is_equal")
        ),
        f"select g.case_id, g.row_no, {_all('g', 'p', _adaptive('g', 'p', 'i'))} as is_equal from {_ALIGNED}",
        extra={"norm": _NORM},
    )
    r.add(
        "results_match_set",
        lambda t: G.results_match_set(t.result_cells),
        "select case_id, d_gold = d_pred and d_gold = coalesce(common, 0) and d_gold > 0 as matches from stats left join shared_rows using (case_id)",
        extra=_BASE,
    )
    r.add(
        "results_match_bag",
        lambda t: G.results_match_bag(t.result_cells),
        "select case_id, coalesce(w_gold = w_pred and n_gold = n_pred and gold_hit and pred_hit2, false) as matches from found "
        "where case_id in (select case_id from stats)",
        extra=_FULL,
    )
    r.add(
        "check_columns",
        lambda t: G.check_columns(t.result_cells),
        "select case_id, case when w_gold > w_pred then 'missing_columns:' || (w_gold - w_pred) else 'extra_columns:' || (w_pred - w_gold) end as reason "
        "from stats join cols using (case_id) where n_gold = n_pred and subset",
        extra={**_BASE, "cols": _COLS},
    )
    r.add(
        "check_duplicates",
        lambda t: G.check_duplicates(t.result_cells),
        """
        select * from (select case_id, case when n_pred = 1 and n_gold > 1 and d_gold = 1 then 'aggregated_equivalent:' || n_gold || '_to_1'
            when n_pred < n_gold and d_gold < n_gold then 'implicit_distinct:' || (n_gold - d_gold) || '_duplicates_removed'
            when n_pred > n_gold and d_pred < n_pred then 'extra_duplicates:' || (n_pred - d_pred) || '_duplicates_in_predicted' end as reason
        from stats join shared_rows using (case_id) where w_gold = w_pred and d_gold = common and d_pred = common) where reason is not null
        """,
        extra=_BASE,
    )
    r.add(
        "check_rows",
        lambda t: G.check_rows(t.result_cells),
        """
        select case_id, case when n_gold > n_pred then 'missing_rows:' || (n_gold - n_pred) else 'extra_rows:' || (n_pred - n_gold) end as reason
        from found where w_gold = w_pred and n_gold <> n_pred and case when n_pred < n_gold then pred_hit else gold_hit end
        """,
        extra=_FULL,
    )
    # the same checks one rule at a time
    for rule, check, source in (
        ("missing_columns", G.check_columns, "check_columns"),
        ("extra_columns", G.check_columns, "check_columns"),
        ("aggregated_equivalent", G.check_duplicates, "check_duplicates"),
        ("implicit_distinct", G.check_duplicates, "check_duplicates"),
        ("extra_duplicates", G.check_duplicates, "check_duplicates"),
        ("missing_rows", G.check_rows, "check_rows"),
        ("extra_rows", G.check_rows, "check_rows"),
    ):
        whole = r.entries[source]
        r.add(
            f"check_{rule}",
            lambda t, c=check, n=rule: c(t.result_cells).filter(F.col("reason").startswith(f"{n}:")),
            f"select * from ({whole.sql}) where starts_with(reason, '{rule}:')",
            extra=whole.extra,
        )
    r.add(
        "check_close_values",
        lambda t: G.check_close_values(t.result_cells),
        "select case_id from near where is_close",
        extra={**_BASE, "near": _CLOSE},
    )
    r.add("compare_results", lambda t: G.compare_results(t.result_cells, t.result_cases), _VERDICT, extra=_FULL)
    r.add("compare_simple", lambda t: G.compare_simple(t.result_cells, t.result_cases), _SIMPLE, extra=_BASE)

    def second(t: Inputs):
        # the prediction itself serves as second reference for every third case
        return t.result_cells.filter("side = 'pred' and case_id % 3 = 0").select("case_id", "row_no", "cells")

    r.add(
        "compare_with_fallback",
        lambda t: G.compare_with_fallback(t.result_cells, t.result_cases, second(t)),
        """
        select v.case_id, case when hit then 'correct' else level end as level, case when hit then 'platinum_match' else reason end as reason,
            case when hit then 'platinum' when level = 'correct' then 'gold' else 'none' end as match_source
        from (select *, level <> 'correct' and case_id % 3 = 0 and case_id in (select case_id from stats where n_pred > 0) as hit from verdict) v
        """,
        extra={**_FULL, "verdict": _VERDICT},
    )
    r.add(
        "audit_engines",
        lambda t: G.audit_engines(t.result_cells, t.result_cases),
        f"select coalesce(mismatch_type, 'match') as outcome, count(*) as n from ({_SIMPLE}) group by 1",
        extra=_BASE,
    )
    r.add(
        "curate_dataset",
        lambda t: G.curate_dataset(t.orders.select(F.col("o_orderkey").alias("case_id"), "o_orderstatus"), t.result_cells, t.result_cases),
        f"""
        select o_orderkey as case_id, o_orderstatus, coalesce(n_gold, 0) as gold_rows, case when s.case_id is null then 'not_audited' when matches then 'compatible'
            when mismatch_type = 'error' then 'error' else 'mismatch' end as status
        from orders left join stats on o_orderkey = stats.case_id left join ({_SIMPLE}) s on o_orderkey = s.case_id
        """,
        extra=_BASE,
    )

    def stored(t: Inputs):
        line = F.concat(F.lit("['"), F.col("o_orderstatus"), F.lit("', "), F.col("o_orderkey").cast("string"), F.lit("]"))
        text = (
            F.when(F.col("o_orderkey") % 4 == 0, F.concat(line, F.lit("\n"), line, F.lit("\n... (sampled 2 of 9 total rows)")))
            .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("["), line, F.lit(", "), line, F.lit("]")))
            .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit("]")))
            .otherwise(F.concat(line, F.lit("\nnot a row\n"), line))
        )
        return t.orders.select(F.col("o_orderkey").alias("case_id"), text.alias("result_text"))

    r.add(
        "parse_result_text",
        lambda t: G.parse_result_text(stored(t)).select(
            "case_id", "row_no", F.size("cells").alias("width"), F.array_join("cells", "|").alias("cells")
        ),
        """
        select o_orderkey as case_id, cast(i as integer) as row_no, case when o_orderkey % 4 = 2 then 1 else 2 end as width,
            case when o_orderkey % 4 = 2 then cast(o_orderkey as varchar) else o_orderstatus || '|' || o_orderkey end as cells
        from orders, lateral (select unnest(case when o_orderkey % 4 = 2 then [0] else [0, 1] end) as i)
        """,
    )

    # ---- answers
    number = "regexp_full_match({c}, '" + _NUM + "')"
    cell = f"""
        case when {number.format(c='c')} then case when asked is not null then format('{{:.' || asked || 'f}}', round_even(cast(c as double), asked))
            when regexp_full_match(c, '[+-]?[0-9]+') then c else cast(cast(c as double) as varchar) end else c end
    """
    pieces = f"""
        select *, list_transform(cells, lambda c: {cell}) as v from (
            select r.case_id, r.row_no, r.cells, g.guidelines, coalesce(regexp_matches(g.guidelines, 'eg:\\s*\\w+,\\s+\\w+'), false) as spaced,
                coalesce(regexp_matches(g.guidelines, '\\[.*\\w+_i\\s*:\\s*\\w+_i'), false) as bracket,
                coalesce(regexp_matches(g.guidelines, '\\{{\\w+\\}}:\\{{\\w+\\}}'), false) as colon,
                try_cast(nullif(regexp_extract(lower(g.guidelines), 'rounded to (\\d+) decimal', 1), '') as integer) as asked,
                count(*) over (partition by r.case_id) as n
            from answer_rows r join answer_guidelines g on r.case_id = g.case_id)
    """
    keyed = "split_part(cells[1], ':', 1) || ': ' || case when asked is not null then format('{:.' || asked || 'f}', round_even(cast(split_part(cells[1], ':', 2) as double), asked)) else split_part(cells[1], ':', 2) end"
    lines = f"""
        select case_id, any_value(case when n = 1 and len(cells) = 1 then 'value' when bracket and len(cells) = 1 and contains(cells[1], ':') then 'keyed'
                when len(cells) = 2 and bracket then 'bracket' when n = 1 and len(cells) = 2 and colon then 'colon' when n = 1 or len(cells) = 1 then 'list'
                when len(cells) = 2 then 'pairs' else 'list' end) as layout, any_value(spaced) as spaced, any_value(bracket) as bracket, any_value(colon) as colon,
            any_value(cells[1]) as cell,
            list(case when bracket and len(cells) = 1 and contains(cells[1], ':') and n > 1 then {keyed} when len(cells) = 2 and bracket then v[1] || ': ' || v[2]
                when n = 1 and len(cells) = 2 and colon then v[1] || ':' || v[2] when n > 1 and len(cells) = 2 then v[1] || case when colon then ':' else ': ' end || v[2]
                when spaced then list_aggregate(v, 'string_agg', ', ') else list_aggregate(v, 'string_agg', ',') end order by row_no) as p
        from pieces group by 1
    """
    r.add(
        "format_answer",
        lambda t: A.format_answer(t.answer_rows, t.answer_guidelines),
        """
        select g.case_id, coalesce(case when layout = 'value' then p[1] when layout in ('keyed', 'bracket') then '[' || list_aggregate(p, 'string_agg', ', ') || ']'
            when layout = 'pairs' or spaced then list_aggregate(p, 'string_agg', ', ') else list_aggregate(p, 'string_agg', ',') end, 'Not Applicable') as answer
        from answer_guidelines g left join lines using (case_id)
        """,
        extra={"pieces": pieces, "lines": lines},
    )
    r.add(
        "normalize_to_gold_format",
        lambda t: A.normalize_to_gold_format(t.answer_pairs, "answer", "gold", "normalized").select("case_id", "normalized"),
    )
    bare = """case when starts_with({c}, '[') and ends_with({c}, ']') then list_aggregate(list_transform(string_split(trim(substr({c}, 2, length({c}) - 2)), ','),
        lambda x: regexp_replace(trim(x), '^[''"]+|[''"]+$', '', 'g')), 'string_agg', ', ') else {c} end"""
    prep = (
        "select *, case when " + number.format(c="gn") + " then cast(gn as double) end as gx, case when " + number.format(c="pn") + " then cast(pn as double) end as px, "
        "list_sort(list_transform(string_split(gn, ','), lambda x: trim(x))) as gl, list_sort(list_transform(string_split(pn, ','), lambda x: trim(x))) as pl from "
        f"(select *, lower({bare.format(c='p')}) as pn, lower({bare.format(c='g')}) as gn from (select *, {_P_TRIM.format(c='answer')} as p, {_P_TRIM.format(c='gold')} as g from {{src}}))"
    )
    no_answer = "('', 'not applicable', 'n/a', 'none', 'na', 'null', '-')"
    equal = f"""
        case when lower(p) = lower(g) or pn = gn then true when pn in {no_answer} and gn in {no_answer} then true
            when gx is not null and px is not null then case when gx = 0 then abs(px) < 1e-9 else abs(gx - px) / greatest(abs(gx), 1e-15) < 1e-9
                or abs(abs(gx) - abs(px)) / greatest(abs(gx), 1e-15) < 1e-9 end
            else (contains(gn, ',') and contains(pn, ',') and gl = pl)
                or (gn <> '' and not contains(gn, ',') and gx is null and starts_with(pn, gn) and substr(pn, length(gn) + 1, 1) in (':', ',', ';'))
                or (pn <> '' and not contains(pn, ',') and px is null and starts_with(gn, pn) and substr(gn, length(pn) + 1, 1) in (':', ',', ';')) end
    """
    r.add(
        "answers_equal",
        lambda t: t.answer_pairs.select("case_id", A.answers_equal(F.col("answer"), F.col("gold")).alias("is_equal")),
        f"select case_id, {equal} as is_equal from prep",
        extra={"prep": prep.format(src="answer_pairs")},
    )
    # the layout of the gold answer, written out for the thirteen kinds of pairs in the input
    laid_out = """
        select a.* exclude (answer), case when failed then 'Not Applicable' else case case_id % 13
            when 0 then trim(substr(answer, 2, length(answer) - 2)) when 1 then replace(answer, ',', ', ')
            when 2 then substr(answer, 1, length(answer) - 2) when 4 then gold when 7 then regexp_replace(replace(substr(answer, 1, length(answer) - 6), ':', ': ') || '7.12]', ':\\s+', ': ', 'g')
            when 8 then gold when 11 then format('{:.1f}', round_even(cast(answer as double), 1)) else answer end end as answer
        from answer_pairs a
    """
    r.add(
        "score_answer",
        lambda t: A.score_answer(t.answer_pairs).select("case_id", "correctness", "score", "match_source", "reason"),
        f"""
        select case_id, case when hit_limit then 'hit_limit' when eq then 'correct' else 'incorrect' end as correctness,
            case when eq and not hit_limit then cast(1 as double) else cast(0 as double) end as score, case when eq and not hit_limit then 'answer_scorer' else 'none' end as match_source,
            case when hit_limit then 'hit_limit' when failed and eq then 'no_sql_produced' when failed then case when has_sql then 'sql_execution_error' else 'no_sql_produced' end end as reason
        from (select *, {equal} as eq from prep)
        """,
        extra={"laid_out": laid_out, "prep": prep.format(src="laid_out")},
    )
