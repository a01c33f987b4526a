"""The registered queries of this subpackage, with production parameters over whole tables, and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import align, bpe, chat, importance, mainpage, near, packing, quality, repeats, templates, vafile, wacz, weak
from evalspark.llm.frames import prepare, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.judge(table(prepare(spark), sf_dir, "documents")).drop("votes", "posterior")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = wacz.write_archives(table(prepare(spark), sf_dir, "pages"))
    r = wacz.read_records(archives)
    number = lambda c: F.nullif(F.regexp_extract(c, r"urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    # what a response says of its payload is what is read; a revisit says it in its headers
    return r.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as h, cast(strlen(coalesce(html, '')) as bigint) as n, sha1(coalesce(html, '')) as d from pages),
r as (select d, max(page_id) as m from p where n >= 1000 group by d),
t as (select p.*, r.m, coalesce(m is not null and (page_id is null or page_id < m), false) as again from p left join r on p.d = r.d)
select page_id, n as payload_bytes, d as payload_digest, case when again then 'revisit' else 'response' end as record_type,
    case when again then m end as refers_to
from t
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.link(table(prepare(spark), sf_dir, "documents"), words=4, similarity=(85, 100))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(prepare(spark), sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(~quality.held_out()))
    found = quality.score(docs, model, ["doc_id"])
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.search(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP6_SQL = """
with v as (
    select vec_id, min(list_transform(embedding, lambda x: floor(64 * cast(x as double)))) as v
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    group by vec_id),
s as (
    select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 20
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_recurring(table(prepare(spark), sf_dir, "documents"), min_tokens=1)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    return mainpage.extract(pages, mainpage.train(pages), ["page_id", "url"])


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(docs, path).withColumn("ids_sha256", F.sha2("ids", 256))
    back = bpe.decode(ids, path, keep=("doc_id", "n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(prepare(spark), sf_dir, "conversations")
    said = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical(rows.select(tricky.columns).unionByName(tricky), "conv_id")
    return chat.digest(chat.render(turns, "conv_id"), "conv_id")


OP12_SQL = r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
    select *, length(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'))
        + length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'), chr(10), '\' || chr(10)))
        + length('<turn>') + 1 + length('</turn>') + 1 as written
    from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(written) as bigint) as formatted_chars
from e group by conv_id
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_warc": op2_warc,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_topk": op6_exact_topk,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES: dict[str, str] = {"op1_quality_rules": weak.oracle(), "op2_warc": OP2_SQL, "op6_exact_topk": OP6_SQL, "op12_chat_formatting": OP12_SQL}
