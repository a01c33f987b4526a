"""Conversation traces, tagged answers, attempt scoring and semantic linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.plans.keyed import join_null_safe, top_n
from evalspark.plans.sequence import running_sums
from evalspark.session import materialize

# Message types of the second trace dialect, and the mark of a final answer.
RESPONSE_TYPES = ["function_call", "function_call_output", "message", "reasoning"]
FINAL_MARK = "FINAL_SQL:"
# Limits of a puzzle.
GROUP_WORDS = 4
# vectors of a database that a task takes of either side
DEALT = 8192

_TOOL_CALLS = "array<struct<id:string,name:string,function:struct<name:string>>>"


# ---------------------------------------------------------------- traces


def explode_messages(records: DataFrame, json: str, key: str = "trace_id") -> DataFrame:
    """One row per element of a JSON array of messages: (key, seq, message)."""
    items = F.from_json(json, "array<string>")
    return records.select(key, F.posexplode(items).alias("seq", "message"))


def content_text(content: Column) -> Column:
    """Text of a message content: a string, or a list of blocks whose texts are joined by line."""
    blocks = F.from_json(content, "array<struct<text:string>>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return F.when(F.ltrim(content).startswith("["), F.coalesce(joined, content)).otherwise(F.coalesce(content, F.lit("")))


def _step(part: Column | int, kind: Column, text: Column, call_id: Column, name: Column, place: Column, total: Column) -> Column:
    part = F.lit(part) if isinstance(part, int) else part
    return F.named_struct(
        F.lit("part"), part.cast("int"), F.lit("kind"), kind, F.lit("text"), text, F.lit("call_id"), call_id,
        F.lit("name"), name, F.lit("place"), place.cast("int"), F.lit("total"), total.cast("int"),
    )


def flatten_trace(messages: DataFrame) -> DataFrame:
    """Ordered steps of traces in either dialect.

    Input (trace_id, seq, message as JSON). Kinds: system, user, thinking, final, tool_call,
    tool_result. A trace speaks the second dialect when any message has one of its types.
    """
    field = lambda name: F.get_json_object("message", f"$.{name}")
    typed = messages.select(
        "trace_id",
        "seq",
        F.coalesce(field("type"), F.lit("")).alias("type"),
        F.coalesce(field("role"), F.lit("")).alias("role"),
        content_text(field("content")).alias("content"),
        content_text(field("summary")).alias("summary"),
        field("thinking").alias("thinking"),
        F.coalesce(field("call_id"), field("tool_call_id"), field("id")).alias("call_id"),
        F.coalesce(field("name"), field("tool_name"), F.lit("unknown")).alias("name"),
        F.coalesce(field("result"), field("output"), field("content"), F.lit("")).alias("result"),
        F.from_json(field("tool_calls"), _TOOL_CALLS).alias("calls"),
    )
    dialect = typed.groupBy("trace_id").agg(F.bool_or(F.col("type").isin(RESPONSE_TYPES)).alias("responses"))
    rows = join_null_safe(typed, dialect, ["trace_id"])
    none, zero = F.lit(None).cast("string"), F.lit(0)
    said = F.length(F.trim("content")) > 0
    answer_kind = F.when(F.col("content").contains(FINAL_MARK), "final").otherwise("thinking")

    def plain(part: int, kind: Column, text: Column) -> Column:
        return _step(part, kind, text, none, none, zero, zero)

    def result() -> Column:
        return _step(9, F.lit("tool_result"), F.col("result"), F.col("call_id"), F.col("name"), zero, zero)

    second = F.array(
        F.when((F.col("type") == "") & F.col("role").isin("user", "system") & said, plain(1, F.col("role"), F.col("content"))),
        F.when((F.col("type") == "message") & (F.col("role") == "assistant") & said, plain(1, answer_kind, F.col("content"))),
        F.when(
            (F.col("type") == "reasoning") & (F.length(F.concat("content", "summary")) > 0),
            plain(1, F.lit("thinking"), F.when(F.length("content") > 0, F.col("content")).otherwise(F.col("summary"))),
        ),
        F.when(
            F.col("type") == "function_call",
            _step(2, F.lit("tool_call"), none, F.col("call_id"), F.col("name"), zero, F.lit(1)),
        ),
        F.when(F.col("type") == "function_call_output", result()),
    )
    calls = F.transform(
        F.coalesce("calls", F.array().cast(_TOOL_CALLS)),
        lambda c, i: _step(
            i + 2,
            F.lit("tool_call"),
            none,
            c["id"],
            F.coalesce(c["function"]["name"], c["name"], F.lit("unknown")),
            i,
            F.size("calls"),
        ),
    )
    first = F.concat(
        F.array(
            F.when(F.col("role").isin("user", "system") & (F.length("content") > 0), plain(1, F.col("role"), F.col("content"))),
            F.when(
                (F.col("role") == "assistant") & (F.length(F.trim("thinking")) > 0), plain(0, F.lit("thinking"), F.col("thinking"))
            ),
            F.when((F.col("role") == "assistant") & said, plain(1, answer_kind, F.col("content"))),
            F.when(F.col("role").isin("tool", "function_call_output"), result()),
        ),
        F.when(F.col("role") == "assistant", calls).otherwise(F.slice(calls, 1, 0)),
    )
    steps = F.array_compact(F.when(F.col("responses"), second).otherwise(first))
    return rows.select("trace_id", "seq", F.explode(steps).alias("s")).select("trace_id", "seq", "s.*")


def step_counters(steps: DataFrame) -> DataFrame:
    """Running numbers of thinking steps, tool results and calling messages within a trace."""
    kind = F.col("kind")
    return running_sums(
        steps,
        ["trace_id"],
        ["seq", "part"],
        {
            "thinking_no": F.when(kind == "thinking", 1).otherwise(0),
            "tool_no": F.when(kind == "tool_result", 1).otherwise(0),
            "response_no": F.when((kind == "tool_call") & (F.col("place") == 0), 1).otherwise(0),
        },
    )


def pair_tool_calls(steps: DataFrame) -> DataFrame:
    """Calls with their results: by id, else the first open call in order; the rest stay open.

    The k-th use of an id meets the k-th result with that id. What is left is paired in order
    within the trace, provided the call came first. Labels number the calling message, with a
    letter when it made several calls.
    """
    # the steps and the pairs by id are read several times, so both are written once
    numbered = materialize(
        step_counters(materialize(steps, "steps")).filter(F.col("kind").isin("tool_call", "tool_result")), "calls"
    )
    is_call = F.col("kind") == "tool_call"
    ranked = running_sums(
        numbered,
        ["trace_id", "call_id", "kind"],
        ["seq", "part"],
        {"_use": F.lit(1)},
    )
    info = F.struct("seq", "part", "name", "response_no", "place", "total", "text", "call_id")

    def sides(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(F.when(is_call, info)).alias("c"), F.max(F.when(~is_call, info)).alias("r"))

    # results without an id never match by id
    known = ranked.withColumn("_id", F.coalesce("call_id", F.concat(F.lit("#"), F.col("kind"), F.col("seq"), F.lit("."), F.col("part"))))
    by_id = materialize(sides(known, ["trace_id", "_id", "_use"]), "by_id")
    done = by_id.filter(F.col("c").isNotNull() & F.col("r").isNotNull()).select("trace_id", "c", "r")
    open_calls = by_id.filter(F.col("r").isNull()).select("trace_id", F.lit("tool_call").alias("kind"), "c.*")
    open_results = by_id.filter(F.col("c").isNull()).select("trace_id", F.lit("tool_result").alias("kind"), "r.*")
    rest = running_sums(
        open_calls.unionByName(open_results), ["trace_id", "kind"], ["seq", "part"], {"_use": F.lit(1)}
    )
    in_order = sides(rest, ["trace_id", "_use"]).select("trace_id", "c", "r")
    fits = F.col("c").isNull() | F.col("r").isNull() | (F.col("c.seq") < F.col("r.seq"))
    split = in_order.filter(~fits)
    none = F.lit(None)
    pairs = (
        done.unionByName(in_order.filter(fits))
        .unionByName(split.withColumn("r", none.cast(in_order.schema["r"].dataType)))
        .unionByName(split.withColumn("c", none.cast(in_order.schema["c"].dataType)))
    )
    # a to z, then aa, ab and so on
    place, small = F.col("c.place"), F.lit("abcdefghijklmnopqrstuvwxyz")
    round_of = F.floor(place / 26).cast("int")
    ahead = F.when(round_of > 26, round_of.cast("string")).when(round_of > 0, F.substring(small, round_of, F.lit(1))).otherwise("")
    letter = F.concat(ahead, F.substring(small, place % 26 + 1, F.lit(1)))
    label = F.concat(F.col("c.response_no").cast("string"), F.when(F.col("c.total") > 1, letter).otherwise(""))
    return pairs.select(
        "trace_id",
        F.col("c.seq").alias("call_seq"),
        F.col("r.seq").alias("result_seq"),
        F.coalesce("c.name", "r.name").alias("name"),
        label.alias("label"),
        F.col("r.text").alias("result"),
        F.col("r").isNotNull().alias("answered"),
    )


# ---------------------------------------------------------------- tagged and fenced text


def tagged(text: Column, tag: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1), r"^\s+|\s+$", ""))


def guess_words(response: Column) -> Column:
    """Guessed words in capitals: the guess tag, else four capitalised names, else all parts."""
    clean = F.regexp_replace(F.regexp_replace(response, r"(?is)<thinking>.*?</thinking>", ""), r"(?is)<thinking>.*", "")
    inside = F.regexp_extract(clean, r"(?is)<guess>(.*?)</guess>", 1)
    names = F.regexp_extract(clean, r"\b[A-Z][A-Z\s]*\b(?:\s*,\s*[A-Z][A-Z\s]*\b){3}", 0)
    chosen = F.when(clean.rlike(r"(?is)<guess>.*?</guess>"), inside).when(names != "", names).otherwise(clean)
    words = F.transform(F.split(chosen, ","), lambda w: F.upper(F.regexp_replace(w, r"^\s+|\s+$", "")))
    return F.filter(words, lambda w: w != "")


def extract_tagged(df: DataFrame, response: str) -> DataFrame:
    """Thinking, guess and confidence of a response, and the guessed words."""
    text = F.col(response)
    return df.withColumns(
        {
            "thinking": tagged(text, "thinking"),
            "guess": tagged(text, "guess"),
            "confidence": tagged(text, "confidence"),
            "words": guess_words(text),
        }
    )


def extract_question_parts(df: DataFrame, prompt: str, answer: str) -> DataFrame:
    """Question and evidence from a prompt, the final statement from an answer."""
    p, a = F.col(prompt), F.col(answer)

    def between(text: Column, start: str, end: str) -> Column:
        after = F.substring_index(F.substr(text, F.instr(text, start) + len(start)), end, 1)
        return F.when(text.contains(start), F.regexp_replace(after, r"^\s+|\s+$", ""))

    fenced = F.regexp_extract(a, r"(?s)```sql(.*?)```", 1)
    return df.withColumns(
        {
            "question": between(p, "**Question:**", "**Hints:**"),
            "evidence": between(p, "**Hints:**", "\n\nHints define"),
            "final_sql": F.when(
                a.contains(FINAL_MARK) & (fenced != ""), F.regexp_replace(fenced, r"^\s+|\s+$", "")
            ),
        }
    )


VERDICT_SCHEMA = "verdict string, confidence string, reasoning string, recommendation string"


def extract_json_block(df: DataFrame, response: str, shown_chars: int | None = None) -> DataFrame:
    """Verdict record from the fenced or first braced JSON of a response, else a fallback record with the
    response, cut to ``shown_chars`` if given."""
    text = F.col(response)
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}", 0)

    def parsed(block: Column) -> Column:
        valid = F.try_parse_json(F.nullif(block, F.lit(""))).isNotNull()
        return F.when(valid, F.from_json(block, VERDICT_SCHEMA))

    fallback = F.struct(
        F.lit("UNCLEAR").alias("verdict"),
        F.lit("LOW").alias("confidence"),
        F.concat(F.lit("Failed to parse response: "), text if shown_chars is None else F.substring(text, 1, shown_chars)).alias("reasoning"),
        F.lit("NEEDS_REVIEW").alias("recommendation"),
    )
    staged = df.withColumn("_block", F.coalesce(parsed(fenced), parsed(braced), fallback))
    return staged.select(*df.columns, "_block.*")


def exception_fields(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Typed error columns; the body excerpt has single spaces and, if given, at most ``limit`` characters.

    Input columns: error_type, error_message, status_code, request_id, fallback_id, body.
    """
    clean = F.trim(F.regexp_replace("body", r"\s+", " "))
    cut = clean
    if limit is not None:
        cut = F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, limit - 3), F.lit("..."))).otherwise(clean)
    return df.withColumns(
        {
            "status_code": F.col("status_code").cast("int"),
            "request_id": F.coalesce(F.nullif("request_id", F.lit("")), F.nullif("fallback_id", F.lit(""))),
            "body_excerpt": F.when(F.length(clean) > 0, cut),
        }
    ).drop("body", "fallback_id")


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


# ---------------------------------------------------------------- puzzle attempts


def guess_features(attempts: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Attempts with their words, overlap per group and the formal error, if any.

    ``attempts``: run_id, puzzle_id, guess_index, response; ``puzzles``: puzzle_id, groups (array
    of word arrays).
    """
    named = attempts.withColumn("words", guess_words(F.col("response"))).join(puzzles, "puzzle_id")
    all_words = F.transform(F.flatten("groups"), lambda w: F.upper(w))
    overlap = F.transform(
        "groups", lambda g: F.size(F.array_intersect("words", F.transform(g, lambda w: F.upper(w))))
    )
    error = (
        F.when(F.size("words") != GROUP_WORDS, "wrong_count")
        .when(F.size(F.array_distinct("words")) != GROUP_WORDS, "duplicate_words")
        .when(F.size(F.array_except("words", all_words)) > 0, "unknown_word")
    )
    return named.select(
        "run_id", "puzzle_id", "guess_index", "words", overlap.alias("overlap"), error.alias("formal_error")
    )


# ---------------------------------------------------------------- schema linking


def _block_pairs(questions: DataFrame, tables: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of the block pairs they take part in; blocks of about ``size`` vectors of a database.

    A vector is copied for every block of the other side, so large blocks keep what is shuffled small.
    """
    n = F.count(F.lit(1))

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("db_id").agg(F.ceil(n / size).cast("int").alias(name))

    sizes = blocks(questions, "n_q").join(blocks(tables, "n_t"), "db_id")

    def placed(df: DataFrame, key: str, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        rows = df.join(sizes, "db_id").withColumn(own_block, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.withColumn(other_block, spread).select("db_id", key, "vector", "q_block", "t_block")

    left = placed(questions, "question_id", "n_q", "n_t", "q_block", "t_block")
    return left, placed(tables, "table_id", "n_t", "n_q", "t_block", "q_block")


def link_tables_topk(questions: DataFrame, tables: DataFrame, k: int = 4, block: int = 1024) -> DataFrame:
    """The ``k`` tables of a question's database that are closest by cosine, with scores.

    ``questions``: question_id, db_id, vector; ``tables``: table_id, db_id, vector. Both sides are dealt into blocks of
    about ``DEALT`` vectors per database. A task takes one block pair, multiplies ``block`` by ``block`` vectors at a time and returns
    only the best ``k`` per question, so a large database is spread over many tasks and no
    list of all pairs exists.
    """
    left, right = _block_pairs(questions, tables, max(block, DEALT))
    keys = ["db_id", "q_block", "t_block"]
    schema = T.StructType(
        [questions.schema["question_id"], tables.schema["table_id"], T.StructField("score", T.DoubleType())]
    )

    def best(q, t):
        import numpy as np
        import pandas as pd

        if q.empty or t.empty:
            return pd.DataFrame({"question_id": [], "table_id": [], "score": []})
        t = t.sort_values("table_id", kind="stable")
        a = np.stack(q["vector"].to_numpy()).astype("float64")
        b = np.stack(t["vector"].to_numpy()).astype("float64")
        with np.errstate(divide="ignore", invalid="ignore"):
            a = a / np.linalg.norm(a, axis=1, keepdims=True)
            b = b / np.linalg.norm(b, axis=1, keepdims=True)

        def first(scores):
            return np.argsort(-scores, axis=1, kind="stable")[:, :k]

        found = []
        for x in range(0, len(a), block):
            places, values = [], []
            for y in range(0, len(b), block):
                scores = np.round(a[x : x + block] @ b[y : y + block].T, 9)
                order = first(scores)
                places.append(order + y)
                values.append(np.take_along_axis(scores, order, axis=1))
            # slices follow each other by table_id, so equal scores still go to the smaller one
            place, value = np.hstack(places), np.hstack(values)
            order = first(value)
            found.append((np.take_along_axis(place, order, axis=1), np.take_along_axis(value, order, axis=1)))
        place, value = (np.vstack(x) for x in zip(*found, strict=True))
        return pd.DataFrame(
            {
                "question_id": np.repeat(q["question_id"].to_numpy(), place.shape[1]),
                "table_id": t["table_id"].to_numpy()[place.ravel()],
                "score": value.ravel(),
            }
        )

    candidates = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)
    return top_n(candidates, ["question_id"], [F.desc("score"), F.col("table_id")], k)


def _fk_names(columns: DataFrame, side: str) -> DataFrame:
    return columns.select(
        "db_id",
        F.col("column_index").alias(f"{side}_index"),
        F.col("table_name").alias(f"{side}_table"),
        F.col("column_name").alias(f"{side}_column"),
    )


def fk_text(foreign_keys: DataFrame, columns: DataFrame) -> DataFrame:
    """Index-encoded foreign keys as ``table.column -> table.column``; unknown indexes give ``?``."""
    named = foreign_keys
    for side in ("from", "to"):
        named = named.join(_fk_names(columns, side), ["db_id", f"{side}_index"], "left")
    unknown = F.lit("?")

    def text(side: str) -> Column:
        return F.concat_ws(".", F.coalesce(f"{side}_table", unknown), F.coalesce(f"{side}_column", unknown))

    return named.select(
        "db_id",
        "from_table",
        "to_table",
        F.concat(text("from"), F.lit(" -> "), text("to")).alias("foreign_key"),
    )


def fk_filter(keys: DataFrame, linked: DataFrame) -> DataFrame:
    """Foreign keys whose two tables both belong to the linked tables (db_id, table_name)."""
    chosen = linked.select("db_id", "table_name").distinct()
    return keys.join(chosen.withColumnRenamed("table_name", "from_table"), ["db_id", "from_table"], "left_semi").join(
        chosen.withColumnRenamed("table_name", "to_table"), ["db_id", "to_table"], "left_semi"
    )
