"""Registered queries of the profiling and facts family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog import querylog as QS
from evalspark.catalog.inputs import RAW_TABLES, Inputs
from evalspark.catalog.registry import Registry
from evalspark.operators import facts as FA
from evalspark.operators import profile as E
from evalspark.operators import querylog as Q
from evalspark.session import materialize

# Column types of the given tables, nested columns left out.
_SCHEMA = {
    "region": "r_regionkey INTEGER, r_name VARCHAR",
    "nation": "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER",
    "customer": "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR",
    "supplier": "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_type VARCHAR, p_size INTEGER, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority VARCHAR",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR",
    "documents": "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, label INTEGER",
    "pages": "page_id BIGINT, url VARCHAR, html VARCHAR",
    "benchmark": "item_id BIGINT, text VARCHAR",
    "labels": "doc_id BIGINT, quality INTEGER, toxic INTEGER",
    "conversations": "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR",
}
_COLUMNS = [(t, *c.strip().split()) for t, cols in _SCHEMA.items() for c in cols.split(",")]


def _stats_sql(table: str, column: str, dtype: str) -> str:
    c = f'"{column}"'
    number = dtype in ("INTEGER", "BIGINT", "DOUBLE")
    text = dtype == "VARCHAR"
    total = f"nullif(sum(length({c})), 0)"

    def share(pattern: str) -> str:
        return f"coalesce(cast(sum(length(regexp_replace({c}, '{pattern}', '', 'g'))) as double) / {total}, 0)"

    hits = ", ".join(f"count(*) filter (regexp_matches({c}, '{p}'))" for _, p in E.TEXT_PATTERNS)
    finest = (
        f"case when bool_or(extract('microsecond' from {c}) <> 0) then 'second' when bool_or(minute({c}) <> 0) then 'minute' "
        f"when bool_or(hour({c}) <> 0) then 'hour' when count({c}) > 0 then 'day' end"
    )
    return (
        f"select '{table}' as \"table\", '{column}' as \"column\", '{dtype}' as dtype, cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value, "
        f"{f'avg({c})' if number else 'cast(null as double)'} as avg, {f'stddev({c})' if number else 'cast(null as double)'} as std, count(*) as \"count\", "
        f"coalesce(count(*) filter ({c} is null) * cast(100 as double) / nullif(count(*), 0), 0) as null_percentage, "
        f"{f'min(length({c}))' if text else 'null'} as min_length, {f'max(length({c}))' if text else 'null'} as max_length, {f'avg(length({c}))' if text else 'null'} as avg_length, "
        f"{share('[^a-zA-Z]') if text else 'null'} as alpha, {share('[^0-9]') if text else 'null'} as digits, count(distinct {c}) as unique_count, "
        f"{f'[{hits}]' if text else 'cast(null as bigint[])'} as hits, count({c}) as known, {finest if dtype == 'TIMESTAMP' else 'cast(null as varchar)'} as finest_part from {table}"
    )


_STATS = " union all ".join(_stats_sql(*c) for c in _COLUMNS)
# timestamps and long numbers print differently in the two engines, so extremes are compared as text only where they print alike
_VALUES = " union all ".join(
    f"select distinct '{t}' as \"table\", '{c}' as \"column\", cast(\"{c}\" as varchar) as value from {t} where \"{c}\" is not null"
    for t, c, d in _COLUMNS
)
_FLAGGED = """
select *, unique_count <= 20 and not (dtype <> 'VARCHAR' and coalesce(try_cast(min_value as double) = 0 and try_cast(max_value as double) > 1
    and unique_count >= (try_cast(max_value as double) + 1) * cast(0.6 as double), false)) as is_categorical from colstats
"""
_RANKED = """
select *, row_number() over (partition by "table", "column" order by value) as rk from colvalues
"""
_SAMPLED = """
select f.*, s.samples from flagged f left join (
    select r."table" as st, r."column" as sc, list(value order by value) as samples from ranked r join flagged g on r."table" = g."table" and r."column" = g."column"
    where rk <= case when is_categorical then least(unique_count, 10) when dtype = 'VARCHAR' then 20 else 0 end group by 1, 2) s
on f."table" = s.st and f."column" = s.sc
"""
# the first pattern that at least 80 percent of all values of a column match
_PATTERN_CASE = (
    "case when dtype <> 'VARCHAR' or known = 0 then null "
    + " ".join(f"when hits[{i}] >= known * cast(0.8 as double) then '{n}'" for i, (n, _) in enumerate(E.TEXT_PATTERNS, start=1))
    + " end"
)
_KEYS = "regexp_matches(lower(\"column\"), '^(id|pk|key)$|(_id|_pk|_key|id)$|^(pk_|id_)')"
_IS_KEY = f'unique_count > 0 and unique_count >= "count" * cast(0.95 as double) and {_KEYS}'
_PROFILED = f"select *, {_PATTERN_CASE} as detected_pattern, {_IS_KEY} as is_primary_key from sampled"
_PROFILE = {
    "colstats": _STATS,
    "colvalues": _VALUES,
    "flagged": _FLAGGED,
    "ranked": _RANKED,
    "sampled": _SAMPLED,
    "profiled": _PROFILED,
}
_SHARED = """
select a."table" as source_table, a."column" as source_column, b."table" as target_table, b."column" as target_column, count(*) as shared
from colvalues a join colvalues b on a.value = b.value and a."table" < b."table" group by 1, 2, 3, 4
"""
_SIMS = """
select s.*, u.n as source_unique, v.n as target_unique, round(shared / cast(u.n + v.n - shared as double), 3) as jaccard_similarity,
    round(shared / cast(least(u.n, v.n) as double), 3) as containment
from shared s join sizes u on u.t = source_table and u.c = source_column join sizes v on v.t = target_table and v.c = target_column
"""
_RELATED = """
select *, case when jaccard_similarity >= cast(0.9 as double) and least(source_unique, target_unique) / cast(greatest(source_unique, target_unique) as double) < 0.5 then 'foreign_key'
    when jaccard_similarity >= cast(0.7 as double) then 'shared_dimension' else 'partial_overlap' end as likely_relationship from sims
"""
_CONTAINED = _RELATED.replace("jaccard_similarity >=", "containment >=")
_SIM = {
    "colvalues": _VALUES,
    "shared": _SHARED,
    "sizes": 'select "table" as t, "column" as c, count(*) as n from colvalues group by 1, 2',
    "sims": _SIMS,
    "related": _RELATED,
    "contained": _CONTAINED,
}
_PREFIX = "^[a-z]_"
_ORPHANS = """
select a."table", a."column", a.ot as other_table, a.oc as other_column, count(*) as orphan_count,
    string_agg(a.value, '|' order by a.value) filter (rk <= 10) as orphan_sample
from (select v."table", v."column", v.value, p."table" as ot, p."column" as oc,
        row_number() over (partition by v."table", v."column", p."table", p."column" order by v.value) as rk
      from colvalues v join (select distinct "table", "column" from colvalues) p
          on regexp_replace(p."column", '^[a-z]_', '') = regexp_replace(v."column", '^[a-z]_', '') and p."table" <> v."table"
      where not exists (select 1 from colvalues w where w."table" = p."table" and w."column" = p."column" and w.value = v.value)) a
group by 1, 2, 3, 4
"""
# ---- facts from the log, reusing the mining checks
_JOINS = """
select case when (lt, lc) <= (rt, rc) then lt else rt end as a_t, case when (lt, lc) <= (rt, rc) then lc else rc end as a_c,
    case when (lt, lc) <= (rt, rc) then rt else lt end as b_t, case when (lt, lc) <= (rt, rc) then rc else lc end as b_c, sum(frequency) as n
from colpairs p where op = '=' and lt <> rt and not exists (select 1 from ctes c where c.cleaned = p.cleaned and c.cte in (lt, rt)) group by 1, 2, 3, 4
"""
_TARGETS = "select a_t as t, a_c as c, b_t as tt, b_c as tc, n from minedjoins union all select b_t, b_c, a_t, a_c, n from minedjoins"
_LOG = {
    **QS._BASE,
    "colpairs": QS._PAIRS,
    "minedjoins": _JOINS,
    "targets": _TARGETS,
    "usage": QS._USAGE,
    "preds": QS._PREDS,
    "metrics": QS._METRICS,
}
_FUNCS = """
select "table" as t, "column" as c, f, sum(occurrence_count) as n from (select distinct p."table", p."column", upper(regexp_extract(m.expression, '^(\\w+)\\s*\\(', 1)) as f, m.expression, m.occurrence_count
    from profiled p join metrics m on list_contains(regexp_extract_all(lower(m.expression), '([a-z_]\\w*)', 1), lower(p."column")))
where f in ('SUM', 'AVG', 'COUNT', 'MIN', 'MAX') group by 1, 2, 3
"""
_ALL_FACTS = {**_PROFILE, **_LOG, "funcs": _FUNCS, "shared": _SHARED, "sizes": _SIM["sizes"], "sims": _SIMS, "related": _RELATED, "contained": _CONTAINED, "orph": _ORPHANS}
_GUESSED = """
select * from (select source_table as t, source_column as c, target_table as tt, target_column as tc, jaccard_similarity as j from contained where likely_relationship = 'foreign_key'
    union all select target_table, target_column, source_table, source_column, jaccard_similarity from contained where likely_relationship = 'foreign_key') g
where not exists (select 1 from targets x where x.t = g.t and x.c = g.c and x.tt = g.tt and x.tc = g.tc)
"""
_BEST = """
select *, case when one then '1' else 'N' end || ':' || case when other then '1' else 'N' end as card from (
    select b.*, (select bool_or(unique_count >= "count" * cast(0.95 as double)) from profiled p where p."table" = b.t and p."column" = b.c) as one,
        (select bool_or(unique_count >= "count" * cast(0.95 as double)) from profiled p where p."table" = b.tt and p."column" = b.tc) as other
    from (select t, c, tt, tc, kind from (select *, row_number() over (partition by t, c order by kind desc, w desc, tt, tc) as rk from (
        select t, c, tt, tc, cast(n as double) as w, true as kind from targets union all select t, c, tt, tc, j, false from guessed)) where rk = 1) b)
"""
_MEASURE = "|".join(FA.MEASURE_WORDS)
_ROLES = f"""
select p.*, b.tt, b.tc, b.kind, b.card, case when is_primary_key then 'pk' when b.kind then 'fk'
    when (ends_with(lower(p."column"), '_id') or (ends_with(lower(p."column"), 'id') and lower(p."column") <> 'id')) and dtype in ('BIGINT', 'INTEGER') then 'fk'
    when dtype = 'TIMESTAMP' then 'timestamp' when dtype = 'DOUBLE' then 'fact' when dtype in ('BIGINT', 'INTEGER') and regexp_matches(lower(p."column"), '{_MEASURE}') then 'fact'
    when dtype in ('BIGINT', 'INTEGER') and coalesce(try_cast(min_value as double) = 0 and try_cast(max_value as double) > 1 and unique_count >= (try_cast(max_value as double) + 1) * cast(0.6 as double), false) then 'fact'
    when dtype in ('BIGINT', 'INTEGER') and b.tt is not null and {_KEYS.replace('"column"', 'p."column"')} then 'fk' when is_categorical then 'dimension' when dtype = 'VARCHAR' then 'dimension' end as role,
    case when dtype = 'TIMESTAMP' then coalesce(finest_part, 'day') end as granularity
from profiled p left join best b on p."table" = b.t and p."column" = b.c
"""
_FACTROWS = """
select r.*, u.where_count, u.group_by_count, u.order_by_count, a.aggs, o.ops, x.orphan_count, x.sample, x.otarget from roles r
left join usage u on u."table" = r."table" and u."column" = r."column"
left join (select t, c, list(f order by n desc, f) as aggs from (select *, row_number() over (partition by t, c order by n desc, f) as rk from funcs) where rk <= 3 group by 1, 2) a
    on a.t = r."table" and a.c = r."column"
left join (select t, c, list(operator order by n desc, operator) as ops from (select *, row_number() over (partition by t, c order by n desc, operator) as rk from (
    select "table" as t, "column" as c, operator, sum(frequency) as n from preds group by 1, 2, 3)) where rk <= 3 group by 1, 2) o on o.t = r."table" and o.c = r."column"
left join (select b.t, b.c, orphan_count, string_split(orphan_sample, '|') as sample, other_table || '.' || other_column as otarget from (
    select *, row_number() over (partition by t, c order by j desc, tt desc, tc desc) as rk from (
        select source_table as t, source_column as c, target_table as tt, target_column as tc, jaccard_similarity as j from related
        union all select target_table, target_column, source_table, source_column, jaccard_similarity from related)) b
    join orph on orph."table" = b.t and orph."column" = b.c and other_table = b.tt and other_column = b.tc where rk = 1) x on x.t = r."table" and x.c = r."column"
"""
_FACTS = {**_ALL_FACTS, "guessed": _GUESSED, "best": _BEST, "roles": _ROLES, "factrows": _FACTROWS}


def _fact_text() -> dict[str, str]:
    """Check SQL for the fact text: one step per optional part, each under the budget."""
    high = """
        select "table" as t, "column" as c, list_filter([ 'role:' || role,
            case when is_categorical and len(samples) > 0 then case when len(samples) > 5 or unique_count > len(samples) then 'enum(' || unique_count || '):[' || array_to_string(samples[1:5], ',') || ',...]'
                else '[' || array_to_string(samples, ',') || ']' end end,
            case when kind then 'fk' else 'fk?' end || coalesce('(' || card || ')', '') || '->' || tt || '.' || tc,
            case when len(aggs) > 0 then 'agg:[' || array_to_string(aggs, ',') || ']' end], lambda p: p is not null) as parts,
        case when orphan_count > 0 then 'orphans(' || orphan_count || '):[' || array_to_string(sample[1:3], ',') || ']->' || otarget end as m1,
        case when null_percentage >= 5 then 'null:' || cast(round_even(null_percentage, 0) as bigint) || '%' end as m2,
        case when not is_categorical then 'range:[' || case when length(min_value) > 15 then substr(min_value, 1, 15) || '...' else min_value end || ',' ||
            case when length(max_value) > 15 then substr(max_value, 1, 15) || '...' else max_value end || ']' end as m3,
        'granularity:' || granularity as m4, case when len(ops) > 0 then 'filter:[' || array_to_string(ops, ',') || ']' end as m5,
        case when coalesce(where_count, 0) >= 5 or coalesce(group_by_count, 0) >= 5 or coalesce(order_by_count, 0) >= 5 then 'used:[' || concat_ws(',', case when where_count >= 5 then 'where' end,
            case when group_by_count >= 5 then 'groupby' end, case when order_by_count >= 5 then 'orderby' end) || ']' end as m6, 'pattern:' || detected_pattern as m7
        from factrows
    """
    out = {"f0": f"select *, array_to_string(parts, ';') as txt, coalesce(list_sum(list_transform(parts, lambda p: length(p) + 1)), 0) as size from ({high})"}
    for i in range(1, 8):
        fits = f"m{i} is not null and size + length(m{i}) + 1 < {FA.FACT_CHARS}"
        out[f"f{i}"] = (
            f"select * replace (case when {fits} then case when txt = '' then m{i} else txt || ';' || m{i} end else txt end as txt, "
            f"case when {fits} then size + length(m{i}) + 1 else size end as size) from f{i - 1}"
        )
    return out


# extremes as text in one form for both engines: a fraction by its value in thousandths
_FIXED_SQL = "case when dtype = 'DOUBLE' then cast(cast(round(cast({c} as double) * 1000) as bigint) as varchar) else regexp_replace({c}, '(\\.[0-9]*[1-9])0+$', '\\1') end as {c}"


def _fixed_text(column: str):
    fraction = F.round(F.col(column).cast("double") * 1000).cast("bigint").cast("string")
    return F.when(F.col("dtype") == "DOUBLE", fraction).otherwise(F.regexp_replace(column, r"(\.[0-9]*[1-9])0+$", "$1")).alias(column)


def _tables(t: Inputs):
    return {name: t.table(name) for name in RAW_TABLES}


def _values(t: Inputs):
    # read for the sets and for the counts of columns
    return materialize(E.column_values(_tables(t), key_length=64), "values")


def _profile(t: Inputs, values=None):
    return E.profile_columns(_tables(t), exact=True, values=values)


def _counted(t: Inputs):
    return E.column_statistics(_tables(t)).join(E.distinct_counts(_values(t)), ["table", "column"])


def _similar(t: Inputs):
    return E.with_relationship(E.column_jaccard_exact(_values(t)))


def _guess(t: Inputs, values=None):
    return E.with_relationship(E.column_jaccard_exact(_values(t) if values is None else values), measure="containment")


def _raw_orphans(t: Inputs):
    # whole values are gathered for the columns that can have orphans only
    tables = _tables(t)
    return E.orphan_values(E.column_values(tables, columns=E.namesakes(tables, _PREFIX)), prefix=_PREFIX)


def _facts(t: Inputs):
    log = t.query_log
    # the profile and the similarities count and compare the same distinct values
    values = _values(t)
    return FA.schema_facts(
        _profile(t, values),
        Q.mine_joins(log),
        Q.mine_field_usage(log),
        Q.mine_metrics(log),
        Q.mine_predicates(log),
        _guess(t, values),
        _raw_orphans(t),
    )


def register(r: Registry) -> None:
    joined = lambda df, *cols: df.withColumns({c: F.array_join(c, "|") for c in cols})
    base = ["table", "column"]

    r.add(
        "profile_columns",
        lambda t: _profile(t).select(
            *base, "dtype", _fixed_text("min_value"), _fixed_text("max_value"),
            "unique_count", "avg", "std", "count", "null_percentage", "is_categorical", "min_length", "max_length", "avg_length", "detected_pattern",
        ),
        f'select "table", "column", dtype, {_FIXED_SQL.format(c="min_value")}, {_FIXED_SQL.format(c="max_value")}, unique_count, avg, std, "count", '
        "null_percentage, is_categorical, min_length, max_length, avg_length, detected_pattern from profiled",
        doubles="avg std null_percentage avg_length",
        longs="min_length max_length",
        extra=_PROFILE,
        digits=3,
    )
    # estimates of distinct values and quantiles have no exact counterpart in SQL
    r.add("profile_columns_estimated", lambda t: E.column_statistics(_tables(t)))
    r.add("profile_schema", lambda t: E.profile_columns(_tables(t)).drop("sample_values"))
    r.add(
        "categorical_flag",
        lambda t: E.categorical_flag(_counted(t)).select(*base, "unique_count", "is_categorical"),
        'select "table", "column", unique_count, is_categorical from flagged',
        extra=_PROFILE,
    )
    r.add(
        "sample_values",
        lambda t: joined(E.sample_values(E.smallest_values(_tables(t))), "sample_values"),
        'select "table", "column", string_agg(value, \'|\' order by value) as sample_values from ranked where rk <= 20 group by 1, 2',
        extra=_PROFILE,
    )
    r.add(
        "string_shape",
        lambda t: E.column_statistics(_tables(t)).filter("dtype = 'VARCHAR'").select(*base, "min_length", "max_length", "avg_length", "alpha_ratio", "numeric_ratio", "special_ratio"),
        'select "table", "column", min_length, max_length, avg_length, round(alpha, 2) as alpha_ratio, round(digits, 2) as numeric_ratio, '
        "round(greatest(cast(0 as double), 1 - alpha - digits), 2) as special_ratio from colstats where dtype = 'VARCHAR'",
        doubles="avg_length alpha_ratio numeric_ratio special_ratio",
        longs="min_length max_length",
        extra=_PROFILE,
        digits=2,
    )
    r.add(
        "detect_pattern",
        lambda t: E.column_statistics(_tables(t)).select(*base, "detected_pattern"),
        f'select "table", "column", {_PATTERN_CASE} as detected_pattern from colstats',
        extra={"colstats": _STATS},
    )
    r.add("minhash_signature", lambda t: E.minhash_signature(_values(t)).withColumn("signature", F.hash("signature")))
    r.add("column_similarity", lambda t: E.column_similarity(E.minhash_signature(_values(t))))
    r.add(
        "column_jaccard_exact",
        lambda t: E.column_jaccard_exact(_values(t)),
        "select * from sims",
        doubles="jaccard_similarity containment",
        extra=_SIM,
        digits=3,
    )
    r.add(
        "classify_relationship",
        lambda t: _similar(t).select("source_table", "source_column", "target_table", "target_column", "likely_relationship"),
        "select source_table, source_column, target_table, target_column, likely_relationship from related",
        extra=_SIM,
    )
    r.add(
        "classify_by_containment",
        lambda t: _guess(t).select("source_table", "source_column", "target_table", "target_column", "likely_relationship"),
        "select source_table, source_column, target_table, target_column, likely_relationship from contained",
        extra=_SIM,
    )
    r.add(
        "orphan_values",
        lambda t: joined(_raw_orphans(t), "orphan_sample"),
        _ORPHANS,
        extra={"colvalues": _VALUES},
    )
    r.add(
        "detect_primary_key",
        lambda t: FA.detect_primary_key(_counted(t)).select(*base, "is_primary_key"),
        f'select "table", "column", {_IS_KEY} as is_primary_key from colstats',
        extra={"colstats": _STATS},
    )
    r.add(
        "date_granularity",
        lambda t: FA.date_granularity(E.column_statistics(_tables(t))).select(*base, "date_granularity"),
        "select \"table\", \"column\", case when dtype = 'TIMESTAMP' then coalesce(finest_part, 'day') end as date_granularity from colstats",
        extra={"colstats": _STATS},
    )
    r.add(
        "column_granularity",
        lambda t: FA.column_granularity(t.events, "ts"),
        "select case when bool_or(extract('second' from ts) <> 0 or extract('microsecond' from ts) <> 0) then 'second' when bool_or(minute(ts) <> 0) then 'minute' "
        "when bool_or(hour(ts) <> 0) then 'hour' else 'day' end as granularity from events",
    )
    r.add(
        "usage_flags",
        lambda t: FA.usage_flags(Q.mine_field_usage(t.query_log)),
        'select "table", "column", where_count >= 5 as used_in_where, group_by_count >= 5 as used_in_groupby, order_by_count >= 5 as used_in_orderby, importance_score from usage',
        longs="importance_score",
        extra=_LOG,
    )
    r.add(
        "column_aggregations",
        lambda t: FA.column_aggregations(Q.mine_metrics(t.query_log), _profile(t)).select(*base, "function", "n"),
        'select t as "table", c as "column", f as "function", n from (select *, row_number() over (partition by t, c order by n desc, f) as rk from funcs) where rk <= 3',
        longs="n",
        extra={**_PROFILE, **_LOG, "funcs": _FUNCS},
    )
    r.add(
        "join_targets",
        lambda t: FA.join_targets(Q.mine_joins(t.query_log)),
        'select t as "table", c as "column", tt as target_table, tc as target_column, n as "count" from targets',
        longs="count",
        extra=_LOG,
    )
    r.add(
        "speculative_joins",
        lambda t: FA.speculative_joins(_guess(t), FA.join_targets(Q.mine_joins(t.query_log))),
        'select t as "table", c as "column", tt as target_table, tc as target_column, j as jaccard_similarity from guessed',
        doubles="jaccard_similarity",
        extra={**_SIM, **_LOG, "guessed": _GUESSED},
        digits=3,
    )
    r.add(
        "join_cardinality",
        lambda t: FA.join_cardinality(FA.join_targets(Q.mine_joins(t.query_log)), _profile(t)).select(*base, "target_table", "target_column", "join_cardinality"),
        """
        select x.t as "table", x.c as "column", x.tt as target_table, x.tc as target_column, case when p.unique_count >= p."count" * cast(0.95 as double) then '1' else 'N' end || ':' ||
            case when q.unique_count >= q."count" * cast(0.95 as double) then '1' else 'N' end as join_cardinality
        from targets x join profiled p on p."table" = x.t and p."column" = x.c join profiled q on q."table" = x.tt and q."column" = x.tc
        """,
        extra={**_PROFILE, **_LOG},
    )
    r.add(
        "filter_operators",
        lambda t: FA.filter_operators(Q.mine_predicates(t.query_log)),
        'select "table", "column", operator, sum(frequency) as n from preds group by 1, 2, 3',
        longs="n",
        extra=_LOG,
    )
    r.add(
        "orphan_info",
        lambda t: joined(FA.orphan_info(_similar(t), _raw_orphans(t)), "orphan_sample"),
        'select "table", "column", orphan_count, array_to_string(sample, \'|\') as orphan_sample, otarget as orphan_target from factrows where orphan_count is not null',
        extra=_FACTS,
    )
    r.add(
        "semantic_role",
        lambda t: _facts(t).select(*base, "semantic_role"),
        'select "table", "column", role as semantic_role from roles',
        extra=_FACTS,
    )
    r.add(
        "schema_facts",
        lambda t: joined(_facts(t), "aggregations", "filter_operators").select(
            *base, "is_primary_key", "semantic_role", "target_table", "target_column", "join_cardinality", "aggregations", "filter_operators", "used_in_where", "orphan_count"
        ),
        """
        select "table", "column", is_primary_key, role as semantic_role, tt as target_table, tc as target_column, card as join_cardinality, array_to_string(aggs, '|') as aggregations,
            array_to_string(ops, '|') as filter_operators, coalesce(where_count >= 5, false) as used_in_where, coalesce(orphan_count, 0) as orphan_count from factrows
        """,
        extra=_FACTS,
    )
    r.add(
        "format_fact_string",
        lambda t: FA.format_fact_string(_facts(t)).select(*base, "fact"),
        'select t as "table", c as "column", txt as fact from f7',
        extra={**_FACTS, **_fact_text()},
    )
    r.add(
        "format_table_fact",
        lambda t: FA.format_table_fact(
            FA.table_facts(
                FA.detect_primary_key(_profile(t)), Q.mine_joins(t.query_log), FA.speculative_joins(_guess(t), FA.join_targets(Q.mine_joins(t.query_log)))
            )
        ),
        """
        select p."table", concat_ws('; ', format('{:,}', any_value("count")) || ' rows', 'pk:' || min("column") filter (is_primary_key), 'joins:' || any_value(j.l)) as fact
        from profiled p left join (select t, string_agg(distinct tt, ',' order by tt) as l from (select t, tt from targets union all select t, tt from guessed) group by 1) j on j.t = p."table" group by 1
        """,
        extra={**_ALL_FACTS, "guessed": _GUESSED},
    )
    r.add(
        "annotation_merge",
        lambda t: FA.annotation_merge(
            E.column_statistics(_tables(t)).select(*base, "dtype"), t.annotations
        ),
        'select c.t as "table", c.c as "column", c.d as dtype, a.annotation from (values '
        + ", ".join(f"('{t}', '{c}', '{d}')" for t, c, d in _COLUMNS)
        + ') c(t, c, d) left join annotations a on a."table" = c.t and a."column" = c.c',
    )
    r.add(
        "validate_annotations",
        lambda t: FA.validate_annotations(t.annotations, E.column_statistics(_tables(t))),
        """
        select "table", "column", w as warning from (select "table", "column", case when "table" = 'nowhere' then 'unknown_table'
                when "column" = 'o_missing' then 'unknown_column' when trim(annotation) = '' then 'empty' when length(annotation) > 200 then 'too_long' end as w from annotations
            union all select "table", "column", 'restates_name' from annotations
                where "table" <> 'nowhere' and "column" <> 'o_missing' and annotation = 'the ' || replace("column", '_', ' ') || ' column')
        where w is not null
        """,
    )
