"""Line dedup by a log-template tree: recurring templates across documents are dropped.

Lines are parsed to a fixed depth: the first level is the number of tokens, the next ``depth`` levels are the
leading tokens. Tokens with a digit are variable fields from the start. In a leaf of the tree a token is
constant at its place if it stands there in at least ``min_docs`` documents; every other token is one more
variable field, and a line's template is what is constant. A line whose template keeps less than ``similar`` of
its tokens is its own template: all its tokens, those with a digit masked. Lines of nothing but tokens with a digit have
no constant to be told apart by, so of these only equal ones share a template.

A template recurs if it stands in at least ``min_docs`` documents that are told apart by what boilerplate can't share: a
digest of their own lines. A line is not a document's own if its template stands in ``min_docs`` documents, if at least
``similar`` of its tokens are constants of its leaf, or if it has six tokens or more and begins or ends with the
three words of a line of the first kind (a changed copy of it). Documents without lines of their own, such as
copies of one document with a word changed here and there, are told apart by the rarest of their other templates that
stand in ``min_docs`` documents, so that such copies mostly count once; how many copies there are doesn't matter. Recurring
lines are dropped in all documents.

Counting is by aggregates that merge in each task first, so a line in a third of all documents is one row per
task. Tokens are looked at only for lines of leaves that may recur; those are marked in a bitmap of a fixed
2**25 bits, which can let too many lines through but never too few.

Cases: null and empty texts have no lines; lines without a word, and of fewer than ``min_tokens`` tokens, are kept;
repeated rows count as documents of their own; a null id is dealt with like any other; other columns are not
read unless kept; no rows give no rows. Lines and tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import bounded_rows, map_batches, written
from evalspark.llm.words import Words, blank_bytes, mix, ranges, signed, slices, spans_hash

LAST = 2**63 - 1
BITS = 25
SLICE = 250_000  # bytes of texts worked on together: arrays of this size stay in a core's cache
_FIELD = np.uint64(0x2545F4914F6CDD1D)


class Lines:
    """The lines of a slice of texts that have at least ``least`` tokens."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int, least: int):
        breaks = np.flatnonzero(data == 10) + 1
        self.offsets = np.unique(np.concatenate([offsets, breaks]))
        w = Words(data, self.offsets)
        self.field = np.zeros(len(w.starts), dtype=bool)
        self.field[np.searchsorted(w.starts, np.flatnonzero((data >= 48) & (data <= 57)), "right") - 1] = True
        spelt = w.hashes
        w.__dict__["hashes"] = np.where(self.field, _FIELD, spelt)
        self.w = w
        count = w.counts
        self.at = np.flatnonzero(count >= least)
        self.n = count[self.at]
        first = w.first[self.at]
        self.first = first
        size = self.n.astype(np.uint64)
        self.leaf = signed(mix(w.runs(first, np.minimum(self.n, depth)) ^ mix(size)))
        body = mix(w.runs(first, self.n) + size)
        fields = np.append(0, np.cumsum(self.field))
        bare = (self.n > 0) & (fields[first + self.n] - fields[first] == self.n)
        body[bare] = mix(spans_hash(spelt, first[bare], (first + self.n)[bare]) + size[bare])
        self.body = signed(body)
        # the text each line belongs to
        self.text = np.searchsorted(offsets, self.offsets[self.at], "right") - 1

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and the last three words of each line; of lines of less than six words their body's."""
        long = self.n >= 6
        head, tail = self.body.view(np.uint64).copy(), self.body.view(np.uint64).copy()
        head[long] = self.w.runs(self.first[long], 3)
        tail[long] = self.w.runs((self.first + self.n - 3)[long], 3)
        return signed(head), signed(tail)


def _line_rows(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """(id, leaf, body, head, tail, whole): the distinct lines of each text, with a digest of all of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for low, high, data, offsets in slices(b.column("text"), SLICE):
                x = Lines(data, offsets, depth, least)
                ids = np.asarray(b.column("id").slice(low, high - low))
                order = np.lexsort((x.body, x.text))
                text, body = x.text[order], x.body[order]
                new = np.ones(len(text), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (body[1:] != body[:-1])
                order, text, body = order[new], text[new], body[new]
                start = np.ones(len(text), dtype=bool)
                start[1:] = text[1:] != text[:-1]
                first = np.flatnonzero(start)
                whole = np.repeat(np.bitwise_xor.reduceat(body, first), np.diff(np.append(first, len(text)))) if len(first) else body
                head, tail = x.ends()
                yield {"id": ids[text], "leaf": x.leaf[order], "body": body, "head": head[order], "tail": tail[order], "whole": whole}

    return map_batches(docs, run, "id long, leaf long, body long, head long, tail long, whole long")


def _token_rows(docs: DataFrame, depth: int, least: int, bitmap) -> DataFrame:
    """(leaf, body, tokens) of the lines whose leaf is marked, once per task; null tokens are variable fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        bits = bitmap.value
        for b in batches:
            for _, _, data, offsets in slices(b.column("text"), SLICE):
                x = Lines(data, offsets, depth, least)
                slot = x.leaf.view(np.uint64) >> np.uint64(64 - BITS)
                marked = np.flatnonzero((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))
                name, at = np.unique(x.body[marked], return_index=True)
                fresh = np.array([n not in seen for n in name.tolist()], dtype=bool)
                if fresh.any():
                    seen.update(name[fresh].tolist())
                    line = marked[at[fresh]]
                    n = x.n[line]
                    places = ranges(x.first[line], n)
                    tokens = pa.array(signed(x.w.hashes[places]), mask=x.field[places])
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), tokens)
                    yield {"leaf": x.leaf[line], "body": x.body[line], "tokens": lists}

    return map_batches(docs.select("text"), run, "leaf long, body long, tokens array<long>")


def recurring_lines(docs: DataFrame, depth: int, min_docs: int, similar: float, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(lines, recurring): all distinct lines by document (id, leaf, body, ...), and the bodies that recur."""
    spark = docs.sparkSession
    lines = written(_line_rows(docs, depth, min_tokens), "lines")
    bodies = lines.groupBy("leaf", "body").agg(F.count(F.lit(1)).alias("docs"))
    leaves = bodies.groupBy("leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    slot = F.shiftrightunsigned("leaf", 64 - BITS)
    marks = leaves.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = marks.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bitmap = np.zeros(2 ** (BITS - 6), dtype=np.uint64)
    for r in bounded_rows(words, 2 ** (BITS - 6)):
        bitmap[r["word"]] = np.uint64(r["bits"] % 2**64)
    tokens = _token_rows(docs, depth, min_tokens, spark.sparkContext.broadcast(bitmap))
    known = bodies.join(leaves, "leaf", "left_semi")
    spelt = written(tokens.dropDuplicates(["leaf", "body"]).join(known, ["leaf", "body"]), "leaf-lines")
    long = spelt.select("leaf", "body", "docs", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token")).where("token is not null")
    constant = long.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("seen")).where(F.col("seen") >= min_docs).drop("seen")
    constant = written(constant, "constant-tokens")
    parts = long.join(constant, ["leaf", "place", "token"])
    named = parts.groupBy("leaf", "body").agg(
        F.bit_xor(F.xxhash64("place", "token")).alias("template"), (F.count(F.lit(1)) / F.first("n")).alias("share")
    )
    named = named.where(F.col("share") >= similar).select("leaf", "body", F.xxhash64("leaf", "template").alias("template"))
    alike = F.col("template").isNotNull()
    own = F.when(alike, F.col("template")).otherwise(F.xxhash64("leaf", "body"))
    named = spelt.select("leaf", "body", "docs").join(named, ["leaf", "body"], "left").select("leaf", "body", "docs", own.alias("template"), alike.alias("alike"))
    named = written(named, "templates")
    found = _held_apart(lines, named, min_docs)
    recurring = named.join(found.select("template"), "template", "left_semi").select("leaf", "body", "template")
    return lines, written(recurring, "recurring-lines")


def _held_apart(lines: DataFrame, named: DataFrame, min_docs: int) -> DataFrame:
    """The templates of ``named`` (leaf, body, template, docs, alike) that ``min_docs`` documents hold which are told apart."""
    common = named.groupBy("template").agg(F.sum("docs").alias("seen")).where(F.col("seen") >= min_docs)
    common = written(common, "common-templates")
    shared = written(named.join(common, "template", "left").where("alike or seen is not null"), "shared-lines")
    # changed copies of common lines are found by their other end
    ends = lines.join(shared.where("seen is not null").select("leaf", "body"), ["leaf", "body"], "left_semi")
    ends = written(ends.select("head", "tail").distinct(), "common-ends")
    kin = [lines.join(ends.select(c).distinct(), c, "left_semi").select("leaf", "body") for c in ("head", "tail")]
    marked = shared.select("leaf", "body", F.when(F.col("seen").isNotNull(), F.col("template")).alias("template"), "seen")
    marked = marked.unionByName(kin[0].union(kin[1]).distinct().join(marked, ["leaf", "body"], "left_anti"), allowMissingColumns=True)
    held = lines.select("id", "whole", "leaf", "body").join(written(marked, "marked-lines"), ["leaf", "body"])
    held = written(held.select("id", "whole", "body", "template", "seen").distinct(), "held-lines")
    docs = held.groupBy("id", "whole").agg(
        F.bit_xor("body").alias("shared"),
        F.slice(F.sort_array(F.collect_set(F.when(F.col("template").isNotNull(), F.struct("seen", "template")))), 1, 2).alias("rare"),
    )
    docs = docs.select("id", "whole", F.col("whole").bitwiseXOR(F.col("shared")).alias("own"), F.col("rare.template").alias("rare"))
    votes = held.where("template is not null").select("id", "whole", "template").join(written(docs, "own-lines"), ["id", "whole"])
    rare = F.when(F.get("rare", F.lit(0)) != F.col("template"), F.get("rare", F.lit(0))).otherwise(F.get("rare", F.lit(1)))
    vote = F.when(F.col("own") != 0, F.col("own")).otherwise(F.coalesce(rare, F.lit(0)))
    apart = votes.select("template", (F.col("own") != 0).alias("by_own"), vote.alias("vote")).distinct().groupBy("template").agg(F.count(F.lit(1)).alias("apart"))
    return apart.where(F.col("apart") >= min_docs)


def drop_recurring(
    docs: DataFrame, depth: int = 3, min_docs: int = 10, similar: float = 0.7, min_tokens: int = 3,
    id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """``id_col``, the columns of ``keep``, n_lines (lines with a word), n_dropped and the text without the
    recurring lines, its other lines as they were."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    rows = docs.select(key.alias("id"), F.col(text_col).alias("text"), F.col(id_col).alias("own"), *kept)
    extra = [f"{c} {t}" for c, t in rows.dtypes[2:]]
    carried = [c.split()[0] for c in extra]
    lines, recurring = recurring_lines(rows.select("id", "text"), depth, min_docs, similar, min_tokens)
    gone = lines.join(recurring, ["leaf", "body"]).groupBy("id").agg(F.collect_set("body").alias("gone"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for low, high, data, offsets in slices(b.column("text"), SLICE):
                own = lambda c: b.column(c).slice(low, high - low)  # noqa: B023, E731
                n, dropped, data, offsets = _without(data, offsets, own("gone"), depth, min_tokens)
                at, held = pa.array(offsets.astype(np.int32)), pa.py_buffer(data)
                there = np.packbits(own("text").is_valid().to_numpy(zero_copy_only=False), bitorder="little")
                text = pa.StringArray.from_buffers(high - low, at.buffers()[1], held, pa.py_buffer(there))
                yield {c: own(c) for c in carried} | {"n_lines": n, "n_dropped": dropped, "text": text}

    schema = ", ".join([*extra, "n_lines long, n_dropped long, text string"])
    joined = rows.join(gone, "id", "left")
    result = map_batches(joined.select("text", "gone", *carried), strip, schema)
    names = [F.col("own").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep or [])]]
    return result.select(*names, "n_lines", "n_dropped", F.col("text").alias(text_col))


def _without(data: np.ndarray, offsets: np.ndarray, gone: pa.Array, depth: int, least: int) -> tuple[np.ndarray, ...]:
    """(lines with a word, dropped lines) of each text, and the bytes and offsets of the texts without the lines of ``gone``."""
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    starts, lengths = edges[:-1], np.diff(edges)
    text = np.searchsorted(offsets, starts, "right") - 1
    size = len(offsets) - 1
    worded = np.logical_or.reduceat(~blank_bytes(data), starts) if len(starts) else np.zeros(0, dtype=bool)
    n = np.bincount(text[worded], minlength=size)
    listed = gone.value_lengths().fill_null(0).to_numpy()
    stay = np.ones(len(starts), dtype=bool)
    has = listed > 0
    if has.any():
        # only texts with something to drop are parsed
        mine = np.flatnonzero(has)
        sizes = np.diff(offsets)[mine]
        x = Lines(data[np.repeat(has, np.diff(offsets))], np.append(0, np.cumsum(sizes)), depth, least)
        bodies = np.asarray(gone.flatten())
        known, code = np.unique(bodies, return_inverse=True)
        pairs = np.repeat(np.arange(len(mine)), listed[mine]) * len(known) + code
        near = np.minimum(np.searchsorted(known, x.body), len(known) - 1)
        hit = (known[near] == x.body) & np.isin(x.text * len(known) + near, pairs)
        stay[np.flatnonzero(has[text])[x.at[hit]]] = False
    dropped = np.bincount(text[~stay], minlength=size)
    kept = np.where(stay, lengths, 0)
    # the break before a dropped last line without one goes too
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True)) if len(text) else np.zeros(0, dtype=np.int64)
    bare = last[~stay[last] & (data[edges[1:][last] - 1] != 10)]
    whole = np.flatnonzero(stay)
    before = np.searchsorted(whole, bare) - 1
    cut = whole[before[before >= 0]]
    cut = cut[text[cut] == text[bare[before >= 0]]]
    kept[cut] -= 1
    left = np.repeat(stay, lengths)
    left[edges[1:][cut] - 1] = False
    return n, dropped, data[left], np.append(0, np.cumsum(np.bincount(text, weights=kept, minlength=size).astype(np.int64)))
