"""Registered queries of the trace, text and linking family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.catalog.registry import Registry
from evalspark.operators import text as J

# the steps written out from the conversations, without reading the messages
_STEPS = """
select conv_id as trace_id, turn as seq, cast(part as integer) as part, kind, txt as text, call_id, name from (
    select conv_id, turn, 1 as part, role as kind, coalesce(text, '') as txt, null as call_id, null as name from conversations where role <> 'assistant' and not (role = 'user' and turn % 4 = 2)
    union all select conv_id, turn, 9, 'tool_result', coalesce(text, ''), case when conv_id % 2 = 1 then 'f' || (turn - 1) when conv_id % 4 = 0 then 'c' || (turn - 1) else '' end, 'unknown'
        from conversations where role = 'user' and turn % 4 = 2
    union all select conv_id, turn, 0, 'thinking', 'hm ' || coalesce(text, ''), null, null from conversations where role = 'assistant' and conv_id % 2 = 0 and turn % 3 = 1
    union all select conv_id, turn, 1, case when turn % 4 = 3 then 'final' else 'thinking' end, case when turn % 4 = 3 then 'FINAL_SQL: ' else '' end || coalesce(text, ''), null, null
        from conversations where role = 'assistant' and conv_id % 2 = 0
    union all select conv_id, turn, 2, 'tool_call', null, 'c' || turn, 'run_sql' from conversations where role = 'assistant' and conv_id % 2 = 0 and turn % 4 = 1
    union all select conv_id, turn, 3, 'tool_call', null, 'd' || turn, 'look' from conversations where role = 'assistant' and conv_id % 2 = 0 and turn % 4 = 1
    union all select conv_id, turn, 2, 'tool_call', null, 'f' || turn, 'query' from conversations where role = 'assistant' and conv_id % 2 = 1 and turn % 4 = 1
        and conv_id in (select conv_id from conversations where role = 'assistant' and conv_id % 2 = 1)
    union all select conv_id, turn, 1, 'thinking', coalesce(text, ''), null, null from conversations where role = 'assistant' and conv_id % 2 = 1 and turn % 4 <> 1)
"""


def _steps(t):
    return J.flatten_trace(t.trace_messages)


def register(r: Registry) -> None:
    r.add(
        "flatten_trace",
        lambda t: _steps(t).select("trace_id", "seq", "part", "kind", "text", "call_id", "name"),
        _STEPS,
    )
    r.add(
        "step_counters",
        lambda t: J.step_counters(_steps(t)).select("trace_id", "seq", "part", "thinking_no", "tool_no"),
        "select trace_id, seq, part, sum(case when kind = 'thinking' then 1 else 0 end) over w as thinking_no, sum(case when kind = 'tool_result' then 1 else 0 end) over w as tool_no "
        "from steps window w as (partition by trace_id order by seq, part rows unbounded preceding)",
        longs="thinking_no tool_no",
        extra={"steps": _STEPS},
    )
    r.add(
        "pair_tool_calls",
        lambda t: J.pair_tool_calls(_steps(t)).select("trace_id", "call_seq", "result_seq", "result"),
        """
        select trace_id, cs as call_seq, rs as result_seq, text as result from matched
        union all select coalesce(oc.trace_id, ors.trace_id), oc.seq, ors.seq, ors.text from oc full join ors on oc.trace_id = ors.trace_id and oc.k = ors.k and oc.seq < ors.seq
        """,
        extra={
            "steps": _STEPS,
            "matched": "select c.trace_id, c.seq as cs, c.part as cp, r.seq as rs, r.text from (select * from steps where kind = 'tool_call') c "
            "join (select * from steps where kind = 'tool_result') r on c.trace_id = r.trace_id and c.call_id = r.call_id",
            "oc": "select *, row_number() over (partition by trace_id order by seq, part) as k from steps where kind = 'tool_call' "
            "and (trace_id, seq, part) not in (select (trace_id, cs, cp) from matched)",
            "ors": "select *, row_number() over (partition by trace_id order by seq, part) as k from steps where kind = 'tool_result' "
            "and (trace_id, seq) not in (select (trace_id, rs) from matched)",
        },
    )
    r.add(
        "content_text",
        lambda t: t.trace_messages.select(
            "trace_id", "seq", J.content_text(F.get_json_object("message", "$.content")).alias("content")
        ),
        "select conv_id as trace_id, turn as seq, case when role = 'user' and turn % 4 = 2 then '' when role = 'assistant' and conv_id % 2 = 1 and turn % 4 = 1 then '' "
        "else case when role = 'assistant' and conv_id % 2 = 0 and turn % 4 = 3 then 'FINAL_SQL: ' else '' end || coalesce(text, '') end as content from conversations",
    )
    r.add(
        "extract_tagged",
        lambda t: J.extract_tagged(t.responses, "response")
        .select("conv_id", "turn", "thinking", "guess", "confidence", F.array_join("words", "|").alias("words")),
        """
        select conv_id, turn, case when turn % 3 = 0 then 'A, b' else '' end as thinking, case when turn % 3 = 0 then trim(regexp_extract(response, '<guess>(.*)</guess>', 1)) else '' end as guess,
            case when turn % 3 = 0 then 'high' else '' end as confidence, array_to_string(list_transform(string_split(case turn % 3 when 0 then regexp_extract(response, '<guess>(.*)</guess>', 1)
                when 1 then substr(response, 7) else response end, ','), lambda w: upper(trim(w))), '|') as words
        from responses
        """,
    )
    r.add(
        "extract_question_parts",
        lambda t: J.extract_question_parts(t.responses, "prompt", "answer").select("conv_id", "turn", "question", "evidence", "final_sql"),
        "select conv_id, turn, regexp_extract(prompt, '\\*\\*Question:\\*\\* (.*?) \\*\\*Hints', 1) as question, regexp_replace(regexp_extract(prompt, '(?s)\\*\\*Hints:\\*\\* (.*?)(?:\n\nHints define things)?$', 1), '^\\s+|\\s+$', '', 'g') as evidence, "
        "case when turn % 2 = 0 then 'select ' || turn end as final_sql from responses",
    )
    r.add(
        "extract_json_block",
        lambda t: J.extract_json_block(t.responses, "judgement").select("conv_id", "turn", "verdict", "confidence", "reasoning", "recommendation"),
        "select conv_id, turn, case turn % 3 when 0 then 'GOLD_CORRECT' when 1 then 'BOTH_WRONG' else 'UNCLEAR' end as verdict, case turn % 3 when 0 then 'HIGH' else 'LOW' end as confidence, "
        "case turn % 3 when 0 then json_extract_string(regexp_extract(judgement, '\\{.*\\}'), '$.reasoning') when 1 then 'r' else 'Failed to parse response: no json' end as reasoning, "
        "case turn % 3 when 0 then 'KEEP_GOLD' else 'NEEDS_REVIEW' end as recommendation from responses",
    )
    vectors = lambda t, key: t.embeddings.select(F.col("vec_id").alias(key), F.col("label").alias("db_id"), F.col("embedding").alias("vector"))
    r.add(
        "link_tables_topk",
        lambda t: J.link_tables_topk(vectors(t, "question_id"), vectors(t, "table_id"), k=4, block=256),
        """
        select question_id, table_id, score, cast(rk as integer) as rank from (select *, row_number() over (partition by question_id order by score desc, table_id) as rk from (
            select q.vec_id as question_id, s.vec_id as table_id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(s.embedding as double[])), 9) as score
            from embeddings q join embeddings s on q.label = s.label)) where rk <= 4
        """,
        doubles="score",
    )
    fk = """
        select k.db_id, a.table_name as from_table, b.table_name as to_table, coalesce(a.table_name, '?') || '.' || coalesce(a.column_name, '?') || ' -> '
            || coalesce(b.table_name, '?') || '.' || coalesce(b.column_name, '?') as foreign_key
        from schema_keys k left join schema_columns a on k.db_id = a.db_id and k.from_index = a.column_index left join schema_columns b on k.db_id = b.db_id and k.to_index = b.column_index
    """
    r.add("fk_text", lambda t: J.fk_text(t.schema_keys, t.schema_columns), fk)
    r.add(
        "fk_filter",
        lambda t: J.fk_filter(J.fk_text(t.schema_keys, t.schema_columns), t.schema_columns.filter("table_name in ('T1', 'T2', 'T4', 'T5', 'T7')")),
        f"select x.* from ({fk}) x where (db_id, from_table) in (select (db_id, table_name) from linked) and (db_id, to_table) in (select (db_id, table_name) from linked)",
        extra={"linked": "select distinct db_id, table_name from schema_columns where table_name in ('T1', 'T2', 'T4', 'T5', 'T7')"},
    )
    r.add(
        "guess_features",
        lambda t: J.guess_features(t.guesses, t.puzzles).select(
            "run_id", "puzzle_id", "guess_index", F.array_join("overlap", ",").alias("overlap"), "formal_error"
        ),
        """
        select run_id, puzzle_id, guess_index, array_to_string(list_transform(groups, lambda g: len(list_intersect(list_transform(g, lambda w: upper(w)), words))), ',') as overlap,
            case when len(words) <> 4 then 'wrong_count' when len(list_distinct(words)) <> 4 then 'duplicate_words'
                when len(list_filter(words, lambda w: not list_contains(list_transform(flatten(groups), lambda x: upper(x)), w))) > 0 then 'unknown_word' end as formal_error
        from (select *, list_transform(string_split(regexp_extract(response, '<guess>(.*)</guess>', 1), ','), lambda w: upper(trim(w))) as words from guesses) join puzzles using (puzzle_id)
        """,
    )
    r.add(
        "exception_fields",
        lambda t: J.exception_fields(
            t.documents.select(
                "doc_id", F.lit("HTTPError").alias("error_type"), F.col("source").alias("error_message"), F.col("n_chars").cast("string").alias("status_code"),
                F.lit("").alias("request_id"), F.col("lang").alias("fallback_id"), F.col("text").alias("body"),
            )
        ),
        "select doc_id, 'HTTPError' as error_type, source as error_message, cast(n_chars as integer) as status_code, lang as request_id, "
        "nullif(c, '') as body_excerpt from (select *, trim(regexp_replace(text, '\\s+', ' ', 'g')) as c from documents)",
    )
    r.add(
        "short_name",
        lambda t: t.pages.select("page_id", J.short_name(F.col("url")).alias("short")),
        "select page_id, list_extract(string_split(url, '/'), -1) as short from pages",
    )
    r.add(
        "token_estimate",
        lambda t: t.documents.select("doc_id", J.token_estimate(F.col("text")).alias("tokens")),
        "select doc_id, cast(ceil(length(text) / 4) as bigint) as tokens from documents",
    )
