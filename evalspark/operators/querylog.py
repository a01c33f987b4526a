"""Query-log mining with regular expressions over distinct statements.

Statements are counted first, so a statement that makes up a third of the log is mined once and
weighted by its frequency. The expressions cover plain SELECT statements with aliases, joins,
common table expressions, string literals and brackets nested up to ``DEPTH`` deep; correlated subqueries
in the middle of a clause are not taken apart. Nothing is cut or left out for its length unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.plans.keyed import top_n
from evalspark.plans.sequence import rank_rows

# Statements about the log or the metadata themselves.
META_MARKS = ["summarize", "comment on", "information_schema.query_history", "metadata."]
# Words that may follow a table name without being its alias.
CLAUSE_WORDS = [
    "where", "join", "on", "group", "order", "left", "right", "inner", "full", "cross", "limit", "having", "union",
    "set", "using", "natural", "values", "select", "as",
]
# Weights of a column's uses, and the limits that mined patterns may be given.
IMPORTANCE = {"select": 1, "where": 2, "join": 3, "group_by": 2, "order_by": 1}
IMPORTANCE_MINIMUM = 50
MINIMUM_OCCURRENCES = 2
OCCURRENCE_SHARE = 0.5 / 100
EXAMPLES = 5
ALIASES = 3
METRIC_CHARS, DERIVED_CHARS, CTE_CHARS = 100, 200, 500
SAMPLES = 30

DEPTH = 5
_LITERAL = r"'[^']*(?:''[^']*)*'"


def _nested(depth: int) -> str:
    """Balanced brackets with literals inside."""
    inner = f"(?:[^()']++|{_LITERAL})*+"
    for _ in range(depth):
        inner = rf"(?:[^()']++|{_LITERAL}|\({inner}\))*+"
    return rf"\({inner}\)"


_BRACKETS = _nested(DEPTH)
# an item of a SELECT list: up to a comma outside of brackets and literals
_ITEM = rf"((?:[^,;()']++|{_LITERAL}|{_BRACKETS})++)"
_NAMED_ITEM = r"(?is)^(.*\S)\s+as\s+(\w+)$"
_AGGREGATE_CALL = r"(?i)\b(sum|avg|count|min|max|stddev|variance)\s*\("
_ARITHMETIC = r"[\w)]\s*[-+*/]\s*[\w(]"
_CALL_OR_CASE = r"(?i)\w\s*\(|\bcase\s+when\b"
_END = r"\)\s*select\b|$"
_SEGMENTS = {
    "select": r"(?i)\bselect\s+(.*?)\s+from\s",
    "where": rf"(?i)\swhere\s+(.*?)(?:\sgroup\s+by\s|\sorder\s+by\s|\shaving\s|\slimit\s|{_END})",
    "join": rf"(?i)\son\s+(.*?)(?:\sjoin\s|\sleft\s|\sinner\s|\swhere\s|\sgroup\s+by\s|\sorder\s+by\s|\slimit\s|{_END})",
    "group_by": rf"(?i)\sgroup\s+by\s+(.*?)(?:\shaving\s|\sorder\s+by\s|\slimit\s|{_END})",
    "order_by": rf"(?i)\sorder\s+by\s+(.*?)(?:\slimit\s|{_END})",
    "having": rf"(?i)\shaving\s+(.*?)(?:\sorder\s+by\s|\slimit\s|{_END})",
}
_REFERENCE = r"(?i)\b(?:from|join|update|into)\s+([\w.]+)(?:\s+(?:as\s+)?(\w+))?"
# set off before table references are read, so that a clause word is never taken for an alias
_CLAUSE_START = r"(?i)\s(join|left|right|inner|full|cross|natural|on|where|group|order|limit|having|union|set|using|values)\b"
_CTE_NAME = r"(?i)(\w+)\s+as\s*\(\s*select\b"
_CTE_BODY = rf"(?i)(\w+)\s+as\s*\(\s*(select\b(?:[^()']++|{_LITERAL}|{_BRACKETS})*+)\)"
_COLUMN = r"\b([A-Za-z_]\w*)\.(\w+)"
_COLUMN_PAIR = r"\b([A-Za-z_]\w*)\.(\w+)\s*(<=|>=|<>|!=|=|<|>)\s*([A-Za-z_]\w*)\.(\w+)"
_PREDICATE = (
    r"(?i)\b([A-Za-z_]\w*)\.(\w+)\s*(<=|>=|<>|!=|=|<|>|\s(?:not\s+)?(?:like|ilike|in|between)\s|\sis\s+not\s|\sis\s)\s*"
    + rf"({_LITERAL}|(?!\(\s*select\b){_BRACKETS}|-?[0-9]+(?:\.[0-9]+)?|null\b|true\b|false\b|current_date\b)"
)
_FIRST_VALUE = rf"^\(\s*({_LITERAL}|[^,)]*[^,)\s])"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _set_off(text: Column) -> Column:
    return F.regexp_replace(text, _CLAUSE_START, " ; $1")


def _zip(text: Column, pattern: str, names: list[str]) -> Column:
    """Array of structs with one field per group of the pattern."""
    return F.arrays_zip(*[_all(text, pattern, i + 1).alias(n) for i, n in enumerate(names)])


# ---------------------------------------------------------------- selection and counting


def log_select(
    log: DataFrame,
    schema: str,
    user: str | None = None,
    since=None,
    limit: int | None = None,
) -> DataFrame:
    """Statements that touch a schema, newest first, without statements about the log itself."""
    text = F.lower("query_text")
    keep = text.contains(f"{schema.lower()}.")
    for mark in META_MARKS:
        keep = keep & ~text.contains(mark)
    if user is not None:
        keep = keep & (F.col("user_name") == user)
    if since is not None:
        keep = keep & (F.col("start_time") >= F.lit(since).cast("timestamp"))
    ordered = log.filter(keep).orderBy(F.desc("start_time"), F.desc("query_id"))
    return ordered if limit is None else ordered.limit(limit)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def log_normalize(log: DataFrame) -> DataFrame:
    """Add the statement with single spaces and its lower-case form."""
    return log.withColumn("cleaned", collapse(F.col("query_text"))).withColumn("normalized", F.lower("cleaned"))


def log_dedupe_frequency(log: DataFrame) -> DataFrame:
    """Distinct statements by lower-case form: frequency, first id and the latest writing."""
    return log_normalize(log).groupBy("normalized").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.min("query_id").alias("first_id"),
        F.max_by("cleaned", F.struct("start_time", "query_id")).alias("cleaned"),
    )


def _statements(log: DataFrame) -> DataFrame:
    """Distinct writings with frequency, resolved references and a text without literals."""
    counted = log_normalize(log).groupBy("cleaned").agg(F.count(F.lit(1)).alias("frequency"))
    scan = F.regexp_replace("cleaned", _LITERAL, "''")
    refs = F.transform(
        _zip(_set_off(F.col("scan")), _REFERENCE, ["full", "alias"]),
        lambda r: F.named_struct(
            F.lit("table"),
            F.lower(F.element_at(F.split(r["full"], r"\."), -1)),
            F.lit("alias"),
            F.when((r["alias"] == "") | F.lower(r["alias"]).isin(CLAUSE_WORDS), F.lit(None)).otherwise(F.lower(r["alias"])),
        ),
    )
    return (
        counted.withColumn("scan", scan)
        .withColumn("refs", refs)
        .withColumn("ctes", F.transform(_all(F.col("scan"), _CTE_NAME, 1), lambda c: F.lower(c)))
    )


def _resolve(refs: Column, name: Column) -> Column:
    """Table behind an alias or table name, NULL when unknown."""
    word = F.lower(name)
    hits = F.filter(refs, lambda r: (r["alias"] == word) | (r["alias"].isNull() & (r["table"] == word)))
    direct = F.filter(refs, lambda r: r["table"] == word)
    return F.coalesce(F.get(hits, F.lit(0))["table"], F.get(direct, F.lit(0))["table"])


def extract_tables(log: DataFrame) -> DataFrame:
    """Tables per distinct statement, names of common table expressions left out."""
    st = _statements(log)
    names = F.array_sort(F.array_except(F.transform("refs", lambda r: r["table"]), F.col("ctes")))
    return st.select("cleaned", "frequency", names.alias("tables"))


def _segment_text(*clauses: str, text: str = "cleaned") -> Column:
    parts = [_all(F.col(text), _SEGMENTS[c], 1) for c in clauses]
    return F.array_join(F.concat(*parts) if len(parts) > 1 else parts[0], " ; ")


def _segment(st: DataFrame, clauses: list[str]) -> Column:
    """The text of the given clauses, joined."""
    return _segment_text(*clauses)


# ---------------------------------------------------------------- patterns


def _column_pairs(st: DataFrame) -> DataFrame:
    found = st.select(
        "frequency", "refs", "ctes",
        F.explode(_zip(F.col("scan"), _COLUMN_PAIR, ["la", "lc", "op", "ra", "rc"])).alias("m"),
    )
    return found.select(
        "frequency",
        "ctes",
        _resolve(F.col("refs"), F.col("m.la")).alias("left_table"),
        F.lower("m.lc").alias("left_column"),
        F.when(F.col("m.op") == "<>", "!=").otherwise(F.col("m.op")).alias("operator"),
        _resolve(F.col("refs"), F.col("m.ra")).alias("right_table"),
        F.lower("m.rc").alias("right_column"),
    ).filter(F.col("left_table").isNotNull() & F.col("right_table").isNotNull())


def mine_joins(log: DataFrame) -> DataFrame:
    """Equalities between columns of two tables, direction-free, with their number."""
    pairs = _column_pairs(_statements(log)).filter(
        (F.col("operator") == "=")
        & (F.col("left_table") != F.col("right_table"))
        & ~F.array_contains("ctes", F.col("left_table"))
        & ~F.array_contains("ctes", F.col("right_table"))
    )
    a = F.struct(F.col("left_table").alias("t"), F.col("left_column").alias("c"))
    b = F.struct(F.col("right_table").alias("t"), F.col("right_column").alias("c"))
    ordered = pairs.select("frequency", F.least(a, b).alias("l"), F.greatest(a, b).alias("r"))
    return ordered.groupBy(
        F.col("l.t").alias("left_table"),
        F.col("l.c").alias("left_column"),
        F.col("r.t").alias("right_table"),
        F.col("r.c").alias("right_column"),
    ).agg(F.sum("frequency").alias("count"))


def mine_field_usage(log: DataFrame) -> DataFrame:
    """Uses of each column by clause and the weighted importance score."""
    st = _statements(log)
    clauses = F.array(
        *[F.struct(F.lit(c).alias("clause"), _segment(st, [c]).alias("text")) for c in IMPORTANCE]
    )
    texts = st.select("frequency", "refs", F.explode(clauses).alias("s"))
    plain = F.regexp_replace("s.text", _LITERAL, "''")
    uses = texts.select("frequency", "refs", "s.clause", F.explode(_zip(plain, _COLUMN, ["a", "c"])).alias("m")).select(
        "frequency", "clause", _resolve(F.col("refs"), F.col("m.a")).alias("table"), F.lower("m.c").alias("column")
    )
    counts = uses.filter(F.col("table").isNotNull()).groupBy("table", "column").agg(
        *[
            F.sum(F.when(F.col("clause") == c, F.col("frequency")).otherwise(0)).alias(f"{c}_count")
            for c in IMPORTANCE
        ]
    )
    total, score = F.lit(0), F.lit(0)
    for clause, weight in IMPORTANCE.items():
        total = total + F.col(f"{clause}_count")
        score = score + F.col(f"{clause}_count") * weight
    return counts.withColumn("total_count", total).withColumn("importance_score", score)


def important_fields(usage: DataFrame, minimum: int = IMPORTANCE_MINIMUM) -> DataFrame:
    return usage.filter(F.col("importance_score") >= minimum)


def _anonymous(value: Column) -> Column:
    """``<number>`` for numbers, short strings as they are, ``<string>`` for longer ones."""
    return (
        F.when(value.startswith("'") & (F.length(value) <= 22), value)
        .when(value.startswith("'"), "'<string>'")
        .when(value.rlike("^-?[0-9]"), "<number>")
        .otherwise(F.upper(value))
    )


def _predicates(log: DataFrame, example_chars: int | None) -> DataFrame:
    st = _statements(log)
    text = _segment(st, ["where", "having"])
    found = st.select("frequency", "refs", F.explode(_zip(text, _PREDICATE, ["a", "c", "op", "v"])).alias("m"))
    word = F.upper(collapse(F.col("m.op")))
    operator = F.when(word == "<>", "!=").when(word.isin("IS", "IS NOT"), F.concat(word, F.lit(" NULL"))).otherwise(word)
    item = F.regexp_extract("m.v", _FIRST_VALUE, 1)
    return found.select(
        "frequency",
        _resolve(F.col("refs"), F.col("m.a")).alias("table"),
        F.lower("m.c").alias("column"),
        operator.alias("operator"),
        _anonymous(F.when(F.col("m.v").startswith("("), item).otherwise(F.col("m.v"))).alias("value_pattern"),
        (F.col("m.v") if example_chars is None else F.substring("m.v", 1, example_chars)).alias("example"),
    ).filter(F.col("table").isNotNull())


def mine_predicates(log: DataFrame, examples: int = EXAMPLES, example_chars: int | None = None) -> DataFrame:
    """Filters per column, operator and anonymised value, with their most frequent written values."""
    keys = ["table", "column", "operator", "value_pattern"]
    found = _predicates(log, example_chars).groupBy(*keys, "example").agg(F.sum("frequency").alias("n"))
    counts = found.groupBy(*keys).agg(F.sum("n").alias("occurrence_count"))
    written = top_n(found, keys, [F.desc("n"), F.col("example")], examples).groupBy(*keys).agg(
        F.array_sort(F.collect_list("example")).alias("example_values")
    )
    return counts.join(written, keys)


def _items(lists: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The items of SELECT lists with their aliases: expression, alias (NULL without one), bare (no literals)."""
    split = lists.select(*keep, F.explode(_all(text, _ITEM, 1)).alias("item")).select(*keep, F.trim("item").alias("item"))
    name = F.lower(F.nullif(F.regexp_extract("item", _NAMED_ITEM, 2), F.lit("")))
    split = split.select(*keep, F.when(name.isNull(), F.col("item")).otherwise(F.regexp_extract("item", _NAMED_ITEM, 1)).alias("e"), name.alias("alias"))
    # a subquery is no computation of its own statement
    plain = split.where(~F.col("e").rlike(r"(?i)^\(\s*select\b"))
    return plain.withColumn("bare", F.regexp_replace("e", _LITERAL, "''"))


def _written_alike(e: Column) -> Column:
    """Aggregate names in capitals, whatever their writing."""
    for name in ("sum", "avg", "count", "min", "max", "stddev", "variance"):
        e = F.regexp_replace(e, rf"(?i)\b{name}\s*\(", f"{name.upper()}(")
    return e


def mine_metrics(log: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Items of SELECT lists that aggregate or compute, with their aliases and tables."""
    found = _items(_statements(log).withColumn("lists", _segment_text("select")), F.col("lists"), "frequency", "refs")
    found = found.where(F.col("bare").rlike(_AGGREGATE_CALL) | F.col("bare").rlike(_ARITHMETIC))
    used = F.transform(_all(F.col("bare"), _COLUMN, 1), lambda a: _resolve(F.col("refs"), a))
    rows = found.select("frequency", _written_alike(F.col("e")).alias("expression"), "alias", F.array_compact(used).alias("tables"))
    if max_chars is not None:
        rows = rows.filter(F.length("expression") <= max_chars)
    counts = rows.groupBy("expression").agg(
        F.sum("frequency").alias("occurrence_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tables")))).alias("tables"),
    )
    named = rows.filter(F.col("alias").isNotNull()).select("expression", "alias").distinct()
    aliases = top_n(named, ["expression"], [F.col("alias")], ALIASES).groupBy("expression").agg(
        F.array_sort(F.collect_list("alias")).alias("aliases")
    )
    joined = counts.join(aliases, "expression", "left")
    return joined.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def mine_intra_constraints(log: DataFrame) -> DataFrame:
    """Comparisons between two columns of one table; equal and unequal are direction-free."""
    pairs = _column_pairs(_statements(log)).filter(F.col("left_table") == F.col("right_table"))
    free = F.col("operator").isin("=", "!=")
    a, b = F.col("left_column"), F.col("right_column")
    return pairs.groupBy(
        F.col("left_table").alias("table"),
        F.when(free, F.least(a, b)).otherwise(a).alias("left_column"),
        "operator",
        F.when(free, F.greatest(a, b)).otherwise(b).alias("right_column"),
    ).agg(F.sum("frequency").alias("occurrence_count"))


def _bodies(st: DataFrame) -> DataFrame:
    return st.select("frequency", "refs", F.explode(_zip(F.col("cleaned"), _CTE_BODY, ["name", "body"])).alias("m"))


def mine_ctes(log: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Common table expressions: definition (cut at ``max_chars`` if given, after counting), tables and
    whether they aggregate."""
    body = F.trim("m.body")
    tables = F.array_sort(
        F.array_distinct(F.transform(_all(_set_off(body), _REFERENCE, 1), lambda r: F.lower(F.element_at(F.split(r, r"\."), -1))))
    )
    grouped = body.rlike(r"(?i)\sgroup\s+by\s|\b(sum|avg|count|min|max)\s*\(")
    found = (
        _bodies(_statements(log))
        .groupBy(F.lower("m.name").alias("cte_name"), body.alias("definition"), tables.alias("tables"), grouped.alias("has_aggregation"))
        .agg(F.sum("frequency").alias("occurrence_count"))
    )
    if max_chars is None:
        return found
    is_long = F.length("definition") > max_chars
    return found.withColumn("definition", F.when(is_long, F.concat(F.substring("definition", 1, max_chars), F.lit("..."))).otherwise(F.col("definition")))


def mine_derived_columns(log: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Named computations in SELECT lists: expression, tables and where they were seen."""
    st = _statements(log)
    inner = _bodies(st).select("frequency", "refs", F.lit("CTE").alias("context"), F.concat(F.col("m.body"), F.lit(" ")).alias("text"))
    outer = st.select(
        "frequency", "refs", F.lit("SELECT").alias("context"), F.regexp_replace("cleaned", _CTE_BODY, "$1 as ()").alias("text")
    )
    lists = inner.unionByName(outer).withColumn("lists", _segment_text("select", text="text"))
    found = _items(lists, F.col("lists"), "frequency", "refs", "context").where("alias is not null")
    found = found.where(F.col("bare").rlike(_ARITHMETIC) | F.col("bare").rlike(_CALL_OR_CASE))
    used = F.transform(_all(F.col("bare"), _COLUMN, 1), lambda a: _resolve(F.col("refs"), a))
    rows = found.select("frequency", "context", "alias", _written_alike(F.col("e")).alias("expression"), F.array_compact(used).alias("tables"))
    if max_chars is not None:
        rows = rows.filter(F.length("expression") <= max_chars)
    return rows.groupBy("alias", "expression").agg(
        F.sum("frequency").alias("occurrence_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tables")))).alias("tables"),
        F.array_sort(F.collect_set("context")).alias("contexts"),
    )


def occurrence_threshold(patterns: DataFrame, log: DataFrame, count: str = "occurrence_count") -> DataFrame:
    """Patterns seen at least twice and in at least half a percent of all statements."""
    total = log.agg(F.count(F.lit(1))).scalar()
    least = F.greatest(F.lit(MINIMUM_OCCURRENCES), F.floor(total * F.lit(OCCURRENCE_SHARE)))
    return patterns.filter(F.col(count) >= least)


# ---------------------------------------------------------------- signatures and samples


def query_signature(log: DataFrame) -> DataFrame:
    """Tables, aggregates, grouping columns and kinds of named expressions per statement."""
    st = _statements(log)
    lists, groups = _segment(st, ["select"]), _segment(st, ["group_by"])
    kinds = F.transform(
        _all(lists, r"(?i)\b(sum|avg|count|min|max|stddev|variance)\s*\([^()]*\)\s+as\s", 1),
        lambda f: F.concat(F.lit("agg:"), F.lower(f)),
    )
    other = F.array_compact(
        F.array(
            F.when(lists.rlike(r"(?i)[\w.]+(\s*[-+*/]\s*[\w.]+)+\s+as\s"), "math"),
            F.when(lists.rlike(r"(?i)\bcase\s+when\b"), "case"),
            F.when(lists.rlike(r"(?i)\bcast\s*\("), "cast"),
        )
    )
    calls = _all(F.col("scan"), r"(?i)\b(sum|avg|count|min|max|stddev|variance)\s*\(", 1)

    def unique(a: Column) -> Column:
        return F.array_sort(F.array_distinct(a))

    return st.select(
        "cleaned",
        "frequency",
        unique(F.array_except(F.transform("refs", lambda r: r["table"]), F.col("ctes"))).alias("tables"),
        unique(F.transform(calls, lambda f: F.upper(f))).alias("aggregates"),
        unique(F.transform(_all(groups, _COLUMN, 2), lambda c: F.lower(c))).alias("group_by_columns"),
        unique(F.concat(kinds, other)).alias("expressions"),
    )


def diverse_samples(log: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Frequent statements that each add a table set, aggregate, grouping column or expression kind.

    Walking statements by frequency, one is kept when it holds the first occurrence of some
    feature; so the kept statements are the best ranked ones per feature.
    """
    sig = query_signature(log)

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(tag), v))

    table_set = F.when(
        F.size("tables") > 0, F.array(F.concat(F.lit("t:"), F.array_join("tables", ",")))
    ).otherwise(F.array().cast("array<string>"))
    features = F.concat(
        table_set,
        tagged("a:", F.col("aggregates")),
        tagged("g:", F.col("group_by_columns")),
        tagged("e:", F.col("expressions")),
        F.array(F.lit("first")),
    )
    place = F.struct((-F.col("frequency")).alias("f"), F.col("cleaned").alias("cleaned"))
    firsts = sig.select(F.explode(features).alias("feature"), place.alias("p")).groupBy("feature").agg(F.min("p").alias("p"))
    kept = firsts.select("p").distinct()
    return kept.orderBy("p.f", "p.cleaned").limit(n).select(
        F.col("p.cleaned").alias("query"), (-F.col("p.f")).alias("frequency")
    )


# ---------------------------------------------------------------- audits


# Clauses whose absence from the predicted statement is reported.
_MISSING = {
    "missing_group_by": "group by",
    "missing_order_by": "order by",
    "missing_limit": "limit 1",
    "missing_distinct": "distinct",
    "missing_having": "having",
    "missing_avg": "avg(",
    "missing_case_when": "case when",
}


def sql_pattern_diff(pairs: DataFrame) -> DataFrame:
    """Clause differences between ``gold_sql`` and ``pred_sql``, counted per rule."""
    gold, pred = F.lower("gold_sql"), F.lower("pred_sql")
    rules = {name: gold.contains(clause) & ~pred.contains(clause) for name, clause in _MISSING.items()} | {
        "extra_group_by": pred.contains("group by") & ~gold.contains("group by"),
        "sum_vs_count": gold.contains("sum(") & pred.contains("count("),
        "count_vs_sum": gold.contains("count(") & pred.contains("sum("),
        "missing_conditional_agg": gold.contains("iif(") & ~pred.contains("iif(") & ~pred.contains("case"),
        "missing_date_extraction": (gold.contains("strftime") | gold.contains("substr")) & ~pred.contains("strftime") & ~pred.contains("substr"),
        "inner_vs_left_join": gold.contains("inner join") & pred.contains("left join"),
        "left_vs_inner_join": gold.contains("left join") & pred.contains("inner join"),
    }
    flags = F.array(*[F.when(hit, name) for name, hit in rules.items()])
    found = pairs.select(F.explode(F.array_compact(flags)).alias("pattern"))
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


# Words a statement may start with, and words it may not contain, to be read-only.
READ_STARTS = ["with", "select", "from", "values", "table", "show", "describe", "desc", "summarize"]
WRITE_WORDS = [
    "insert", "update", "delete", "drop", "create", "alter", "attach", "detach", "copy", "install", "load", "set", "reset", "call", "pragma", "truncate",
    "merge", "upsert", "grant", "revoke", "vacuum", "checkpoint", "begin", "start", "commit", "rollback", "export", "import", "use",
]


def read_only(statement: Column) -> Column:
    """One statement, a reading start, no writing word anywhere, no EXPLAIN ANALYZE."""
    text = F.regexp_replace(F.trim(F.regexp_replace(statement, r"^\s+|\s+$", "")), r";+\s*$", "")
    return (
        (F.length(text) > 0)
        & ~text.contains(";")
        & ~text.rlike(r"(?i)\bexplain\s+analyze\b")
        & text.rlike(r"(?i)^(" + "|".join(READ_STARTS) + r")\b")
        & ~text.rlike(r"(?i)\b(" + "|".join(WRITE_WORDS) + r")\b")
    )


def read_only_guard(log: DataFrame) -> DataFrame:
    return log.withColumn("is_read_only", F.coalesce(read_only(F.col("query_text")), F.lit(False)))


def cross_database_audit(log: DataFrame, allowed: str) -> DataFrame:
    """Statements that leave the allowed database, with the first reason found."""
    text = F.upper(F.trim(F.regexp_replace("query_text", r"^\s+|\s+$", "")))
    ident = r'(?:"([^"]+)"|([A-Z_][A-Z0-9_]*))'
    three = rf"{ident}\s*\.\s*{ident}\s*\.\s*{ident}"
    names = F.zip_with(
        _all(text, three, 1), _all(text, three, 2), lambda quoted, bare: F.when(quoted != "", quoted).otherwise(bare)
    )
    foreign = F.get(F.filter(names, lambda d: d != allowed.upper()), F.lit(0))
    dropped = F.transform(
        _all(text, r"\bDROP\s+(?:DATABASE|SCHEMA)\s+(?:IF\s+EXISTS\s+)?([^\s;]+)", 1), lambda d: F.regexp_replace(d, "['\"]", "")
    )
    drop_target = F.get(F.filter(dropped, lambda d: d != allowed.upper()), F.lit(0))
    reason = (
        F.when(text.rlike(r"\bUSE\s+[^\s;]+"), "USE")
        .when(text.rlike(r"\bATTACH\b"), "ATTACH")
        .when(text.rlike(r"\bDETACH\b"), "DETACH")
        .when(foreign.isNotNull(), F.concat(F.lit("cross-database "), F.lower(foreign)))
        .when(drop_target.isNotNull(), "DROP DATABASE")
    )
    return log.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def catalog_search(
    items: DataFrame, fields: list[str], term: str, sort: str, allowed: dict[str, str], default: str, key: str,
    descending: bool = True,
) -> DataFrame:
    """Case-free search in several text fields, sorted by an allowed column, NULL last, id as tie-break."""
    column = allowed.get(sort, allowed[default])
    needle = term.strip().lower()
    out = items
    if needle:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(needle)), F.lit(False))
        out = items.filter(hit)
    order = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return out.orderBy(order, F.asc(key))


def stored_pattern_lookup(patterns: DataFrame, keys: list[str], value: str, count: str, n: int | None = None) -> DataFrame:
    """Stored patterns per key, most frequent first, numbered; the first ``n`` if given."""
    if n is None:
        ranked = rank_rows(patterns.withColumn("_order", -F.col(count)), keys, ["_order", value])
    else:
        ranked = top_n(patterns, keys, [F.desc(count), F.col(value)], n)
    return ranked.select(*keys, "rank", value, count)
