"""Substring dedup: words of long passages that also stand in a document with a smaller id.

A suffix begins at every word. Only its path down to a depth of ``window`` words matters: two suffixes with one
path meet in a deep internal node, and a node's smallest document keeps the passage. Suffixes are kept from
the tree early, by prefixes of varying length:

* Of the ``gram``-word grams of a window the one with the least hash is its anchor, so a path leads from its
  suffix, over a prefix of up to ``window`` words, through its anchor. Equal windows have equal anchors, and
  neighbouring windows mostly share theirs: a few per cent of the words are anchors.
* Anchors are counted first. A suffix whose anchor occurs in one document only is a leaf and goes no further.
* A document whose whole word sequence stands in a smaller one adds no node that its twin does not have.

What is left is dealt out by path, equal paths merged in the task that made them, so a passage that
a third of all documents share is a node of a few rows wherever it is gathered. Runs of suffixes below such nodes
are the maximal repeats. Going back, nodes meet the documents below them by path, which Spark can split
where a path is hot, and the documents' texts by id.

Texts travel compressed, once to their anchors and, if they have shared anchors, once more to their repeats.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; a null id counts as the
largest; rows with one id are judged alike and never against each other; other columns are not read unless
kept; no rows give no rows. Grams and paths are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import map_batches, written
from evalspark.llm.words import Words, mix, ranges, signed, slices

LAST = 2**63 - 1


class Paths:
    """Anchors and paths of all windows of a slice of texts."""

    def __init__(self, w: Words, window: int, gram: int):
        grams, per_text = w.run_starts(gram)
        g = w.runs(grams, gram)
        self.starts, self.n = w.run_starts(window)
        place = ranges(np.cumsum(per_text) - per_text, self.n)
        width, least = 1, g
        span = window - gram + 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
            width *= 2
        if width < span:
            extra = span - width
            least = np.minimum(least[:-extra], least[extra:]) if len(least) > extra else least[:0]
        self.first = np.append(0, np.cumsum(self.n))
        self.anchors = signed(least[place]) & ~np.int64(1)  # even: whole sequences have odd marks
        self.w, self.window = w, window

    def codes(self) -> np.ndarray:
        return signed(self.w.runs(self.starts, self.window))


def _marks(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(mark, id): the distinct anchors of each text, and a mark of its whole word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for low, high, data, offsets in slices(b.column("text")):
                w = Words(data, offsets)
                p = Paths(w, window, gram)
                long = np.flatnonzero(p.n > 0)
                whole = signed(mix(w.runs(w.first[long], w.counts[long]) + w.counts[long].astype(np.uint64))) | np.int64(1)
                ids = np.asarray(b.column("id").slice(low, high - low))
                of = np.repeat(np.arange(high - low), p.n)
                new = np.ones(len(of), dtype=bool)  # neighbouring windows share anchors
                new[1:] = (p.anchors[1:] != p.anchors[:-1]) | (of[1:] != of[:-1])
                marks, of = p.anchors[new], of[new]
                order = np.lexsort((marks, of))
                marks, of = marks[order], of[order]
                new = np.ones(len(of), dtype=bool)
                new[1:] = (marks[1:] != marks[:-1]) | (of[1:] != of[:-1])
                yield {"mark": np.concatenate([marks[new], whole]), "id": np.concatenate([ids[of[new]], ids[long]])}

    return map_batches(docs, run, "mark long, id long")


def _kept_text(w: Words, i: int, gone: np.ndarray, joiner: bytes | None) -> bytes:
    """Text ``i`` without the words marked in ``gone``: words joined anew, or the text with the rest cut out."""
    first = w.first[i]
    starts, ends = w.starts[first : w.first[i + 1]], w.ends[first : w.first[i + 1]]
    raw = w.data
    if joiner is not None:
        return joiner.join(raw[a:b].tobytes() for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True))
    if not gone.any():
        return w.text_of(i)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out, at = [], int(w.offsets[i])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # repeats, with the white space behind
        out.append(raw[at : int(starts[a])].tobytes())
        at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
    out.append(raw[at : int(w.offsets[i + 1])].tobytes())
    return b"".join(out)


def remove_repeats(
    docs: DataFrame, window: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, joiner: str | None = " "
) -> DataFrame:
    """``id_col``, the columns of ``keep``, n_words, n_removed, spans and text.

    ``spans`` holds [first word, end word) of the removed runs; ``text`` is what is left, its words joined by
    ``joiner``, or the text with the runs cut out if ``joiner`` is None.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram must fit into a window")
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"), F.col(id_col).alias("own"), *kept)
    extra = [f"{c} {t}" for c, t in rows.dtypes[2:]]
    carried = [c.split()[0] for c in extra]

    marks = written(_marks(rows.select("id", "text"), window, gram), "marks")
    common = marks.groupBy("mark").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("mark", "low")
    common = written(common, "shared-marks")
    met = marks.join(common, "mark").groupBy("id")
    is_anchor = F.col("mark").bitwiseAND(F.lit(1)) == 0
    known = met.agg(
        F.collect_set(F.when(is_anchor, F.col("mark"))).alias("anchors"),
        F.collect_set(F.when(~is_anchor & (F.col("low") < F.col("id")), F.col("mark"))).alias("twins"),
    )

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            small = [zlib.compress(data[x:y].tobytes(), 1) for _, _, data, offsets in slices(b.column("text")) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield {"id": b.column("id"), "body": pa.array(small, pa.binary())} | {c: b.column(c) for c in carried}

    bodies = map_batches(rows, shrink, ", ".join(["id long", "body binary", *extra]))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Per row the paths of its suffixes with shared anchors; null where there are none."""
        for b in batches:
            found: list[np.ndarray | None] = []
            whole: list[bool] = []
            for body, anchors, twins in zip(*(b.column(c).to_pylist() for c in ("body", "anchors", "twins")), strict=True):
                paths, twin = None, False
                if anchors or twins:
                    data = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
                    w = Words(data, np.array([0, len(data)]))
                    if w.counts[0] >= window:
                        mark = signed(mix(w.runs(w.first[:1], w.counts) + w.counts.astype(np.uint64))) | np.int64(1)
                        twin = int(mark[0]) in (twins or ())
                        if not twin and anchors:
                            p = Paths(w, window, gram)
                            paths = np.unique(p.codes()[np.isin(p.anchors, np.array(anchors, dtype=np.int64))])
                found.append(paths if paths is not None and len(paths) else None)
                whole.append(twin)
            part = {"id": b.column("id"), "body": b.column("body"), "twin": pa.array(whole, pa.bool_())}
            yield part | {"paths": pa.array(found, pa.list_(pa.int64()))} | {c: b.column(c) for c in carried}

    joined = bodies.join(known, "id", "left")
    held = map_batches(joined, leaves, ", ".join(["id long", "body binary", "twin boolean", "paths array<long>", *extra]))
    held = written(held, "suffixes")

    suffixes = held.where("paths is not null").select("id", F.explode("paths").alias("path"))
    nodes = suffixes.groupBy("path").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("path", "low")
    nodes = written(nodes, "nodes")
    below = suffixes.join(nodes, "path").where("low < id").groupBy("id").agg(F.collect_set("path").alias("repeats"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            repeats = b.column("repeats")
            out: list[tuple] = []
            for i, (body, twin) in enumerate(zip(b.column("body").to_pylist(), b.column("twin").to_pylist(), strict=True)):
                data = np.frombuffer(zlib.decompress(body), dtype=np.uint8)
                w = Words(data, np.array([0, len(data)]))
                n = int(w.counts[0])
                gone = np.full(n, twin, dtype=bool)
                if not twin and repeats[i].is_valid:
                    p = Paths(w, window, gram)
                    hit = np.flatnonzero(np.isin(p.codes(), np.asarray(repeats[i].values)))
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + window, -1)
                    gone = np.cumsum(edge)[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans = [{"first": x, "end": y} for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                text = _kept_text(w, 0, gone, None if joiner is None else joiner.encode())
                out.append((n, int(gone.sum()), spans, text.decode("utf-8", "replace")))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield {c: b.column(c) for c in carried} | {
                "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()),
                "spans": pa.array(cols[2], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "text": pa.array(cols[3], pa.string()),
            }

    # texts without shared anchors need no second way
    lone = held.where("paths is null").withColumn("repeats", F.lit(None).cast("array<long>"))
    ready = held.where("paths is not null").join(below, "id", "left")
    schema = ", ".join([*extra, "n_words long, n_removed long, spans array<struct<first: long, end: long>>, text string"])
    columns = ["body", "twin", "repeats", *carried]
    result = map_batches(lone.select(columns), strip, schema).unionByName(map_batches(ready.select(columns), strip, schema))
    names = [F.col("own").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep or [])]]
    return result.select(*names, "n_words", "n_removed", "spans", F.col("text").alias(text_col))
