"""Registered queries of the query-log mining family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.inputs import LOG_STATEMENTS
from evalspark.catalog.registry import Registry
from evalspark.operators import querylog as Q


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORDS = "(" + ", ".join(f"'{w}'" for w in Q.CLAUSE_WORDS) + ")"
_STM = """
select *, regexp_replace(cleaned, '''[^'']*(''''[^'']*)*''', '''''', 'g') as scan from (
    select cleaned, count(*) as frequency from (select trim(regexp_replace(query_text, '\\s+', ' ', 'g')) as cleaned from query_log) group by 1)
"""
_REFS = f"""
select cleaned, tbl, coalesce(alias, tbl) as name from (
    select cleaned, lower(list_extract(string_split(f, '.'), -1)) as tbl, case when a = '' or lower(a) in {_WORDS} then null else lower(a) end as alias
    from (select cleaned, unnest(regexp_extract_all(so, {_text(Q._REFERENCE)}, 1)) as f, unnest(regexp_extract_all(so, {_text(Q._REFERENCE)}, 2)) as a
        from (select cleaned, regexp_replace(scan, {_text(Q._CLAUSE_START)}, ' ; \\1', 'g') as so from stm)))
"""
_CTES = f"select cleaned, lower(unnest(regexp_extract_all(scan, {_text(Q._CTE_NAME)}, 1))) as cte from stm"
_BASE = {"stm": _STM, "refs": _REFS, "ctes": _CTES}


def _groups(source: str, text: str, pattern: str, names: list[str], keep: str) -> str:
    cols = ", ".join(f"unnest(regexp_extract_all({text}, {_text(pattern)}, {i + 1})) as {n}" for i, n in enumerate(names))
    return f"select {keep}, {cols} from {source}"


_PAIRS = f"""
select m.cleaned, frequency, l.tbl as lt, lower(lc) as lc, case when op = '<>' then '!=' else op end as op, r.tbl as rt, lower(rc) as rc
from ({_groups('stm', 'scan', Q._COLUMN_PAIR, ['la', 'lc', 'op', 'ra', 'rc'], 'cleaned, frequency')}) m
join refs l on l.cleaned = m.cleaned and l.name = lower(la) join refs r on r.cleaned = m.cleaned and r.name = lower(ra)
"""


def _segment(clauses: list[str]) -> str:
    lists = " || ".join(f"regexp_extract_all(cleaned, {_text(Q._SEGMENTS[c])}, 1)" for c in clauses)
    return f"array_to_string({lists}, ' ; ')"


_USES = " union all ".join(
    f"select m.cleaned, frequency, '{c}' as clause, r.tbl, lower(m.c) as col from ("
    + _groups(
        f"(select cleaned, frequency, regexp_replace({_segment([c])}, '''[^'']*(''''[^'']*)*''', '''''', 'g') as seg from stm)",
        "seg",
        Q._COLUMN,
        ["a", "c"],
        "cleaned, frequency",
    )
    + ") m join refs r on r.cleaned = m.cleaned and r.name = lower(m.a)"
    for c in Q.IMPORTANCE
)
_COUNTS = ", ".join(f"sum(case when clause = '{c}' then frequency else 0 end) as {c}_count" for c in Q.IMPORTANCE)
_USAGE = (
    f"select *, {' + '.join(f'{c}_count' for c in Q.IMPORTANCE)} as total_count, "
    f"{' + '.join(f'{c}_count * {w}' for c, w in Q.IMPORTANCE.items())} as importance_score "
    f'from (select tbl as "table", col as "column", {_COUNTS} from ({_USES}) group by 1, 2)'
)
_USAGE_LONGS = " ".join([*[f"{c}_count" for c in Q.IMPORTANCE], "total_count", "importance_score"])
# What the statement templates hold, written down by hand and weighted by how often each template was logged.
_N = len(LOG_STATEMENTS)
_TIMES = f"(select event_id % {_N} as t, event_id % 5 = 2 as small, count(*) as n from events group by 1, 2)"


def _values(rows: list[tuple], names: str) -> str:
    quoted = lambda v: "null" if v is None else str(v) if isinstance(v, int | bool) else "'" + v.replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) x({names})"


_PREDICATES = [
    (0, "customer", "c_mktsegment", "=", "'BUILDING'", "'BUILDING'"),
    (1, "lineitem", "l_quantity", ">", "<number>", "30"),
    (1, "orders", "o_orderstatus", "=", "'F'", "'F'"),
    (3, "big", "mean_price", ">=", "<number>", "1000"),
    (4, "part", "p_size", "BETWEEN", "<number>", "5"),
    (5, "lineitem", "l_discount", "IN", "<number>", "(0.05, 0.07)"),
    (6, "supplier", "s_acctbal", "IS NOT NULL", "NULL", "NULL"),
    (6, "supplier", "s_name", "LIKE", "'Supplier%'", "'Supplier%'"),
    (8, "orders", "o_orderdate", ">=", "'1997-01-01'", "'1997-01-01'"),
    (9, "orders", "o_orderkey", "IS NULL", "NULL", "NULL"),
    (16, "customer", "c_name", "=", "'it''s, (not) ours'", "'it''s, (not) ours'"),
    (19, "part", "p_name", "=", "'it''s'", "'it''s'"),
    (19, "part", "p_container", "IN", "'a,b'", "('a,b', 'c')"),
]
_PREDS = f"""
select n as frequency, "table", "column", operator, value_pattern, example
from {_values(_PREDICATES, 't, "table", "column", operator, value_pattern, example')} join {_TIMES} using (t)
"""
# (template, alias, expression, place, does it aggregate or compute)
_COMPUTED = [
    (0, "total", "SUM(o.o_totalprice)", "SELECT", True),
    (2, "customers", "COUNT(c.c_custkey)", "SELECT", True),
    (3, "mean_price", "AVG(o.o_totalprice)", "CTE", True),
    (4, "dearest", "MAX(p.p_retailprice)", "SELECT", True),
    (7, "saved", "SUM(l.l_extendedprice * l.l_discount)", "SELECT", True),
    (8, "rows_total", "COUNT(*)", "SELECT", True),
    (16, "n", "COUNT(*)", "CTE", True),
    (17, "total_tax", "SUM(COALESCE(l.l_tax, 0))", "SELECT", True),
    (17, "mean_discount", "ROUND(AVG(l.l_discount), 2)", "SELECT", True),
    (17, None, "MAX(m.l_quantity)", "SELECT", True),
    (18, "net", "l.l_quantity * (1 - l.l_discount)", "SELECT", True),
    (18, "level", "CASE WHEN l.l_tax > 0.05 THEN 'high, very' ELSE 'low' END", "SELECT", False),
    (20, "gap", "s.s_acctbal - s.s_nationkey", "SELECT", True),
]
_COMPUTED_ROWS = f"select * from {_values(_COMPUTED, 't, alias, expression, context, is_metric')} join {_TIMES} using (t)"
_METRICS = f"""
select expression, sum(n) as occurrence_count, list_sort(list(distinct alias) filter (alias is not null))[1:3] as aliases
from ({_COMPUTED_ROWS}) where is_metric group by 1
"""
_DERIVED = f"""
select alias, expression, sum(n) as occurrence_count, string_agg(distinct context, ',' order by context) as contexts
from ({_COMPUTED_ROWS}) where alias is not null group by 1, 2
"""
_CTE_ROWS = [
    (3, "big", "SELECT o.o_custkey, AVG(o.o_totalprice) AS mean_price FROM shop.orders o GROUP BY o.o_custkey", "orders", True),
    (16, "a", "SELECT o.o_custkey, COUNT(*) AS n FROM shop.orders o GROUP BY o.o_custkey", "orders", True),
    (16, "b", "SELECT c.c_custkey FROM shop.customer c WHERE c.c_name = 'it''s, (not) ours'", "customer", False),
]
_CTE_SQL = f"""
select cte_name, case when small then replace(definition, 'SELECT', 'select') else definition end as definition, tables, has_aggregation, sum(n) as occurrence_count
from {_values(_CTE_ROWS, 't, cte_name, definition, tables, has_aggregation')} join {_TIMES} using (t) group by all
"""
_AGG_KIND = r"(?i)\b(sum|avg|count|min|max|stddev|variance)\s*\([^()]*\)\s+as\s"
_SIG = f"""
select s.cleaned, s.frequency, coalesce(t.tables, []) as tables,
    list_sort(list_distinct(list_transform(regexp_extract_all(scan, '(?i)\\b(sum|avg|count|min|max|stddev|variance)\\s*\\(', 1), lambda f: upper(f)))) as aggregates,
    list_sort(list_distinct(list_transform(regexp_extract_all({_segment(['group_by'])}, {_text(Q._COLUMN)}, 2), lambda c: lower(c)))) as group_by_columns,
    list_sort(list_distinct(list_transform(regexp_extract_all({_segment(['select'])}, {_text(_AGG_KIND)}, 1), lambda f: 'agg:' || lower(f))
        || case when regexp_matches({_segment(['select'])}, '(?i)[\\w.]+(\\s*[-+*/]\\s*[\\w.]+)+\\s+as\\s') then ['math'] else [] end
        || case when regexp_matches({_segment(['select'])}, '(?i)\\bcase\\s+when\\b') then ['case'] else [] end
        || case when regexp_matches({_segment(['select'])}, '(?i)\\bcast\\s*\\(') then ['cast'] else [] end)) as expressions
from stm s left join (select cleaned as t_cleaned, list_sort(list(distinct tbl)) as tables from refs where (cleaned, tbl) not in (select (cleaned, cte) from ctes) group by 1) t
    on s.cleaned = t.t_cleaned
"""
_META = " and ".join(f"not contains(lower(query_text), '{m}')" for m in Q.META_MARKS)
_READ = "|".join(Q.READ_STARTS)
_WRITE = "|".join(Q.WRITE_WORDS)


_LOWER = {"l": "select lower(gold_sql) as g, lower(pred_sql) as p from sql_pairs"}


_DIFF_SQL = """
select pattern, count(*) as n from (select unnest([
        case when g like '%group by%' and p not like '%group by%' then 'missing_group_by' end,
        case when g not like '%group by%' and p like '%group by%' then 'extra_group_by' end,
        case when g like '%order by%' and p not like '%order by%' then 'missing_order_by' end,
        case when g like '%limit 1%' and p not like '%limit 1%' then 'missing_limit' end,
        case when g like '%distinct%' and p not like '%distinct%' then 'missing_distinct' end,
        case when g like '%having%' and p not like '%having%' then 'missing_having' end,
        case when g like '%sum(%' and p like '%count(%' then 'sum_vs_count' end,
        case when g like '%count(%' and p like '%sum(%' then 'count_vs_sum' end,
        case when g like '%avg(%' and p not like '%avg(%' then 'missing_avg' end,
        case when g like '%case when%' and p not like '%case when%' then 'missing_case_when' end,
        case when g like '%iif(%' and p not like '%iif(%' and p not like '%case%' then 'missing_conditional_agg' end,
        case when regexp_matches(g, 'strftime|substr') and not regexp_matches(p, 'strftime|substr') then 'missing_date_extraction' end,
        case when g like '%inner join%' and p like '%left join%' then 'inner_vs_left_join' end,
        case when g like '%left join%' and p like '%inner join%' then 'left_vs_inner_join' end]) as pattern
    from l) where pattern is not null group by 1
"""


def register(r: Registry) -> None:
    joined = lambda df, *cols: df.withColumns({c: F.array_join(c, ",") for c in cols})

    r.add(
        "log_select",
        lambda t: Q.log_select(t.query_log, "shop", user="user2", since="2024-01-10").select("query_id", "start_time"),
        f"select query_id, start_time from query_log where contains(lower(query_text), 'shop.') and {_META} and user_name = 'user2' and start_time >= timestamp '2024-01-10'",
    )
    r.add(
        "log_normalize",
        lambda t: Q.log_normalize(t.query_log).select("query_id", "normalized"),
        "select query_id, lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))) as normalized from query_log",
    )
    r.add(
        "log_dedupe_frequency",
        lambda t: Q.log_dedupe_frequency(t.query_log),
        "select lower(c) as normalized, count(*) as frequency, min(query_id) as first_id, arg_max(c, {'a': start_time, 'b': query_id}) as cleaned "
        "from (select *, trim(regexp_replace(query_text, '\\s+', ' ', 'g')) as c from query_log) group by 1".replace("{'a': start_time, 'b': query_id}", "struct_pack(a := start_time, b := query_id)"),
    )
    r.add(
        "extract_tables",
        lambda t: joined(Q.extract_tables(t.query_log), "tables"),
        "select s.cleaned, frequency, coalesce(x.tables, '') as tables from stm s left join (select cleaned, string_agg(distinct tbl, ',' order by tbl) as tables from refs "
        "where (cleaned, tbl) not in (select (cleaned, cte) from ctes) group by 1) x on s.cleaned = x.cleaned",
        extra=_BASE,
    )
    joins = """
        select case when (lt, lc) <= (rt, rc) then lt else rt end as left_table, case when (lt, lc) <= (rt, rc) then lc else rc end as left_column,
            case when (lt, lc) <= (rt, rc) then rt else lt end as right_table, case when (lt, lc) <= (rt, rc) then rc else lc end as right_column, sum(frequency) as count
        from colpairs p where op = '=' and lt <> rt and not exists (select 1 from ctes c where c.cleaned = p.cleaned and c.cte in (lt, rt)) group by 1, 2, 3, 4
    """
    r.add("mine_joins", lambda t: Q.mine_joins(t.query_log), joins, longs="count", extra={**_BASE, "colpairs": _PAIRS})
    r.add("mine_field_usage", lambda t: Q.mine_field_usage(t.query_log), _USAGE, longs=_USAGE_LONGS, extra=_BASE)
    r.add(
        "important_fields",
        lambda t: Q.important_fields(Q.mine_field_usage(t.query_log)).select("table", "column", "importance_score"),
        f'select "table", "column", importance_score from ({_USAGE}) where importance_score >= 50',
        longs="importance_score",
        extra=_BASE,
    )
    r.add(
        "mine_predicates",
        lambda t: Q.mine_predicates(t.query_log).withColumn("example_values", F.array_join("example_values", " | ")),
        """
        select "table", "column", operator, value_pattern, sum(n) as occurrence_count, string_agg(example, ' | ' order by example) filter (rk <= 5) as example_values
        from (select *, row_number() over (partition by "table", "column", operator, value_pattern order by n desc, example) as rk from (
            select "table", "column", operator, value_pattern, example, sum(frequency) as n from preds group by 1, 2, 3, 4, 5)) group by 1, 2, 3, 4
        """,
        longs="occurrence_count",
        extra={**_BASE, "preds": _PREDS},
    )
    r.add(
        "mine_metrics",
        lambda t: joined(Q.mine_metrics(t.query_log).drop("tables"), "aliases"),
        f"select expression, occurrence_count, coalesce(array_to_string(aliases, ','), '') as aliases from ({_METRICS})",
        longs="occurrence_count",
        extra=_BASE,
    )
    r.add(
        "mine_intra_constraints",
        lambda t: Q.mine_intra_constraints(t.query_log),
        """
        select lt as "table", case when op in ('=', '!=') then least(lc, rc) else lc end as left_column, op as operator,
            case when op in ('=', '!=') then greatest(lc, rc) else rc end as right_column, sum(frequency) as occurrence_count
        from colpairs where lt = rt group by 1, 2, 3, 4
        """,
        longs="occurrence_count",
        extra={**_BASE, "colpairs": _PAIRS},
    )
    r.add("mine_ctes", lambda t: joined(Q.mine_ctes(t.query_log), "tables"), _CTE_SQL, longs="occurrence_count")
    r.add(
        "mine_derived_columns",
        lambda t: joined(Q.mine_derived_columns(t.query_log).drop("tables"), "contexts"),
        _DERIVED,
        longs="occurrence_count",
        extra=_BASE,
    )
    r.add(
        "occurrence_threshold",
        lambda t: Q.occurrence_threshold(Q.mine_joins(t.query_log), t.query_log, "count"),
        f"select * from ({joins}) where count >= greatest(2, floor((select count(*) from query_log) * cast(0.005 as double)))",
        longs="count",
        extra={**_BASE, "colpairs": _PAIRS},
    )
    r.add(
        "query_signature",
        lambda t: joined(Q.query_signature(t.query_log), "tables", "aggregates", "group_by_columns", "expressions"),
        "select cleaned, frequency, " + ", ".join(f"array_to_string({c}, ',') as {c}" for c in ("tables", "aggregates", "group_by_columns", "expressions")) + " from sig",
        extra={**_BASE, "sig": _SIG},
    )
    r.add(
        "diverse_samples",
        lambda t: Q.diverse_samples(t.query_log),
        """
        select query, frequency from (select distinct cleaned as query, frequency from (
            select *, row_number() over (partition by feature order by frequency desc, cleaned) as rk from (
                select cleaned, frequency, unnest(['first'] || case when len(tables) > 0 then ['t:' || array_to_string(tables, ',')] else [] end
                    || list_transform(aggregates, lambda x: 'a:' || x) || list_transform(group_by_columns, lambda x: 'g:' || x)
                    || list_transform(expressions, lambda x: 'e:' || x)) as feature from sig)) where rk = 1) order by frequency desc, query limit 30
        """,
        extra={**_BASE, "sig": _SIG},
    )
    r.add("sql_pattern_diff", lambda t: Q.sql_pattern_diff(t.sql_pairs), _DIFF_SQL, extra=_LOWER)
    trimmed = "regexp_replace(trim(query_text), ';+\\s*$', '')"
    r.add(
        "read_only_guard",
        lambda t: Q.read_only_guard(t.query_log).select("query_id", "is_read_only"),
        f"select query_id, length(s) > 0 and not contains(s, ';') and not regexp_matches(s, '(?i)\\bexplain\\s+analyze\\b') and regexp_matches(s, '(?i)^({_READ})\\b') "
        f"and not regexp_matches(s, '(?i)\\b({_WRITE})\\b') as is_read_only from (select query_id, {trimmed} as s from query_log)",
    )
    r.add(
        "cross_database_audit",
        lambda t: Q.cross_database_audit(t.query_log, "shop").select("query_id", "reason", "is_valid"),
        """
        select query_id, reason, reason is null as is_valid from (select query_id, case when regexp_matches(s, '\\bUSE\\s+[^\\s;]+') then 'USE'
            when regexp_matches(s, '\\bATTACH\\b') then 'ATTACH' when regexp_matches(s, '\\bDETACH\\b') then 'DETACH'
            when len(d) > 0 then 'cross-database ' || lower(d[1]) end as reason from (
            select query_id, s, list_filter(regexp_extract_all(s, '([A-Z_][A-Z0-9_]*)\\s*\\.\\s*[A-Z_][A-Z0-9_]*\\s*\\.\\s*[A-Z_][A-Z0-9_]*', 1), lambda x: x <> 'SHOP') as d
            from (select query_id, upper(trim(query_text)) as s from query_log)))
        """,
    )
    r.add(
        "catalog_search",
        lambda t: Q.catalog_search(
            t.part, ["p_name", "p_type"], "Ring", "size", {"size": "p_size", "name": "p_name"}, "name", "p_partkey"
        ).select("p_partkey", "p_name", "p_size"),
        "select p_partkey, p_name, p_size from part where p_name ilike '%ring%' or p_type ilike '%ring%'",
    )
    r.add(
        "stored_pattern_lookup",
        lambda t: Q.stored_pattern_lookup(
            Q.mine_predicates(t.query_log), ["table", "column"], "value_pattern", "occurrence_count"
        ).withColumn("rank", F.col("rank").cast("bigint")),
        """
        select "table", "column", row_number() over (partition by "table", "column" order by occurrence_count desc, value_pattern) as rank, value_pattern, occurrence_count
        from (select "table", "column", operator, value_pattern, sum(frequency) as occurrence_count from preds group by 1, 2, 3, 4)
        """,
        longs="occurrence_count",
        extra={**_BASE, "preds": _PREDS},
    )
