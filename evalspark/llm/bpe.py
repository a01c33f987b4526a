"""Byte-level BPE encoding and decoding with overlapping chunks.

Long texts are cut into overlapping chunks that become rows of their own, so one long text is worked on
by many tasks. A scan for pre-tokens that began anywhere has a boundary wherever white space follows
something else, and goes on alike from there: all scans resynchronise at such places. Two neighbouring
chunks therefore part at the first such place of the overlap they share. Where the overlap has none, both
hand out the characters around the cut, which are stitched and encoded when the text is put together.

Cases: a null or empty text has no ids; repeated rows are encoded each; ids of rows may be null or repeated,
for rows are told apart by their place in the input; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import map_batches
from evalspark.llm.tokens import tiktoken_encoder
from evalspark.llm.words import ranges, slices

CHUNK, OVERLAP = 65_536, 1_024
_SYNC = regex.compile(r"\S(?=\s)")


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _binary(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One little-endian binary value for each part of ``ids``."""
    data = pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))
    offsets = pa.py_buffer((bounds * 4).astype(np.int64))
    wide = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, offsets, data])
    return wide.cast(pa.binary())


def cut(text: str, chunk: int, size: int, overlap: int, last: bool) -> tuple[str, str, str]:
    """(characters of an open start, text between two meeting points, characters of an open end).

    ``text`` is the chunk with its overlap into the next one. An open part is what no meeting point of the
    overlap bounds; the parts of successive chunks, one after another, are the whole text.
    """
    low = 0
    head = ""
    if chunk:
        m = _SYNC.search(text, 0, min(overlap, len(text)))
        if m:
            low = m.end()
        else:  # open: up to the first meeting point of the chunk itself
            m = _SYNC.search(text, 0, len(text) if last else size)
            low = m.end() if m else (len(text) if last else size)
            head = text[:low]
    if last:
        return head, text[low:], ""
    m = _SYNC.search(text, size, size + overlap)
    if m:
        return head, text[low : m.end()], ""
    end = low
    for m in _SYNC.finditer(text, low, size):
        end = m.end()
    return head, text[low:end], text[end:size]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id_col``, n_tokens, ids: the ids of each whole text as little-endian unsigned 32-bit integers."""
    if not 0 < overlap < size:
        raise ValueError("the overlap must be shorter than a chunk")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.length("text"), F.lit(0)) > size

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, _ = tiktoken_encoder(path)
        for b in batches:
            for low, high, _, _ in slices(b.column("text")):
                ids, bounds = encoder.ids(_texts(b.column("text").slice(low, high - low)))
                yield {"id": b.column("id").slice(low, high - low), "n_tokens": np.diff(bounds), "ids": _binary(ids, bounds)}

    kind = rows.schema["id"].dataType.simpleString()
    short = map_batches(rows.filter(~is_long), whole, f"id {kind}, n_tokens long, ids binary")

    number = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")))
    chunks = (
        rows.filter(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("id", "row", "text", number.alias("chunk"))
        .select(
            "id", "row", "chunk",
            ((F.col("chunk") + 1) * size >= F.length("text")).alias("last"),
            F.expr(f"substring(text, chunk * {size} + 1, {size + overlap})").alias("text"),
        )
        .repartition("row", "chunk")
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, _ = tiktoken_encoder(path)
        for b in batches:
            for low, high, _, _ in slices(b.column("text")):
                part = b.slice(low, high - low)
                cuts = [
                    cut(t, c, size, overlap, z)
                    for t, c, z in zip(_texts(part.column("text")), part.column("chunk").to_pylist(), part.column("last").to_pylist(), strict=True)
                ]
                ids, bounds = encoder.ids([x[1] for x in cuts])
                yield {
                    "id": part.column("id"), "row": part.column("row"), "chunk": part.column("chunk"),
                    "head": pa.array([x[0] for x in cuts]), "ids": _binary(ids, bounds), "tail": pa.array([x[2] for x in cuts]),
                }

    parts = map_batches(chunks, pieces, f"id {kind}, row long, chunk int, head string, ids binary, tail string")
    texts = parts.groupBy("row").agg(
        F.first("id").alias("id"),
        F.sort_array(F.collect_list(F.struct("chunk", "head", "ids", "tail"))).alias("parts"),
    )

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder, _ = tiktoken_encoder(path)
        for b in batches:
            for i in range(b.num_rows):
                found: list[bytes] = []
                loose = ""
                for p in b.column("parts")[i].as_py():
                    loose += p["head"]
                    if p["ids"] or p["tail"]:
                        if loose:
                            found.append(encoder.ids([loose])[0].tobytes())
                        found.append(p["ids"])
                        loose = p["tail"]
                if loose:
                    found.append(encoder.ids([loose])[0].tobytes())
                ids = b"".join(found)
                yield {"id": b.column("id").slice(i, 1), "n_tokens": np.array([len(ids) // 4]), "ids": pa.array([ids])}

    long = map_batches(texts.select("id", "parts"), stitch, f"id {kind}, n_tokens long, ids binary")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``bytes``: the bytes of all ids one after another. Null ids give null bytes."""
    kept = rows.select(*keep, F.col(ids_col).alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        _, spelled = tiktoken_encoder(path)
        length = np.fromiter(map(len, spelled), np.int64, len(spelled))
        flat = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        first = np.cumsum(length) - length
        for b in batches:
            for low, high, data, offsets in slices(b.column("_ids"), 1_000_000):
                ids = np.frombuffer(data.tobytes(), dtype="<u4")
                n = length[ids]
                ends = np.append(0, np.cumsum(n))[offsets // 4]
                spelt = flat[ranges(first[ids], n)]
                wide = pa.Array.from_buffers(pa.large_binary(), high - low, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(spelt)])
                part = b.slice(low, high - low)
                found = wide.cast(pa.binary())
                if part.column("_ids").null_count:
                    found = pa.array([x if ok else None for x, ok in zip(found.to_pylist(), part.column("_ids").is_valid().to_pylist(), strict=True)], pa.binary())
                yield {c: part.column(c) for c in keep} | {"bytes": found}

    types = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(kept, run, f"{types}, bytes binary")
