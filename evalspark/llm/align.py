"""Cross-tokenizer alignment by interval coalescing.

Two tokenizers cut the bytes of a text into tokens A and B. Tokens are intervals of bytes; all intervals of both
sides are sorted by their start, and a running maximum of their ends is accumulated. A group breaks where a start
reaches the running maximum, which is where an A and a B token both end. Inside a group every A token is
linked with every B token.

* Distinct pre-tokens are encoded once per worker by the libraries (``tokens.Lexicon``), and whole slices of texts are
  coalesced at once. A group's links are expanded over its distinct ids with multiplicities, in bounded pieces, so a long
  stretch without a common boundary costs ids times ids, not tokens times tokens.
* The count of an id pair is the number of documents that hold it linked. Tasks work on blocks of a few megabytes of text
  and hand out each distinct pair of a block once, with its number of documents in the block; these are summed, and
  a pair's count is looked up once per block, not once per document. The documents of a block then meet the block's
  counts, cogrouped by block: what a task holds is bounded by a block, or by one text if that is longer.
* The highest count per A id has one row per entry of A's vocabulary, which bounds what is broadcast.

Cases: null and empty texts have no tokens, nor have texts whose joined token bytes of a side differ from a space and the
text (those with U+2581, which side B takes for a space): they take part in nothing. Repeated rows are
documents each; ids may be null or repeated; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import map_batches, written
from evalspark.llm.tokens import Lexicon, end_marked, tokenizers_encoder, with_whole
from evalspark.llm.words import ranges, slices

BLOCK_BYTES = 4_000_000  # text per block of documents
EXPAND = 1_000_000  # links expanded at once
_SHIFT = 20  # ids are below 2**20, so that a pair of them and a document's place fit into one long
_ID = (1 << _SHIFT) - 1
_SPACE_SIGN = "▁"


# -- the two sides ---------------------------------------------------------------------------------------------------------


def byte_signs() -> dict[str, int]:
    """The printable sign that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class PieceEncoder:
    """Encodes texts that begin with a blank by a sentencepiece model, whose own leading blank that one is.

    Where no piece has a blank behind another sign, no merge crosses from a sign to a blank, so each run of blanks with
    the signs behind it is encoded alone, and only once. Otherwise texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.parted = all(_SPACE_SIGN not in p.lstrip(_SPACE_SIGN) for p in pieces)
        self.blank = self.model.piece_to_id(_SPACE_SIGN)
        self.spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.lexicon = Lexicon(self._encode)

    def many(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts whose first sign is the blank that the model adds; a lone blank is a piece of its own."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids if len(t) > 1 else [self.blank] for t, ids in zip(texts, found, strict=True)]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.many(pieces)
        return np.array([i for ids in found for i in ids], dtype=np.uint32), np.array([len(ids) for ids in found], dtype=np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts or not self.parted:
            flat, count = self._encode(texts)
            return flat, np.append(0, np.cumsum(count))
        joined, codes, marks = end_marked(texts)
        blank = (codes == 32) | (codes == ord(_SPACE_SIGN))
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[np.append(0, marks[:-1] + 1)] = True
        start[marks] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(codes))
        real = ~np.isin(starts, marks)
        starts, ends = starts[real], ends[real]
        flat, count, wrong = self.lexicon.ids(codes, starts, ends, joined)
        return with_whole(texts, flat, count, np.append(0, np.searchsorted(starts, marks)), np.unique(np.searchsorted(marks, starts[wrong])), self.many)


@dataclass
class Side:
    """An encoder of texts and the bytes of its ids, flat."""

    encoder: object
    length: np.ndarray
    first: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, encoder, spelt: list[bytes]) -> Side:
        if len(spelt) > _ID:
            raise ValueError("a vocabulary of more than a million entries")
        length = np.fromiter(map(len, spelt), np.int64, len(spelt))
        return cls(encoder, length, np.cumsum(length) - length, np.frombuffer(b"".join(spelt), dtype=np.uint8))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, bounds = self.encoder.ids(texts)
        return ids.astype(np.int64), bounds

    def spelled_right(self, ids: np.ndarray, bounds: np.ndarray, truth: list[bytes]) -> np.ndarray:
        """The texts whose joined token bytes are the given bytes."""
        total = np.append(0, np.cumsum(self.length[ids]))[bounds]
        right = np.diff(total) == np.fromiter(map(len, truth), np.int64, len(truth))
        texts = np.flatnonzero(right)
        if not len(texts):
            return right
        own = ids[ranges(bounds[texts], np.diff(bounds)[texts])]
        spelt = self.flat[ranges(self.first[own], self.length[own])]
        same = spelt == np.frombuffer(b"".join(truth[i] for i in texts.tolist()), dtype=np.uint8)
        n = np.diff(total)[texts]
        right[texts] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        return right


_sides: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """Side A by a byte-level file of the tokenizers library, side B by a sentencepiece model; kept per worker."""
    if (path_a, path_b) not in _sides:
        from tokenizers import Tokenizer

        signs = byte_signs()
        entries = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            spelt[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        pieces = PieceEncoder(path_b)
        _sides[path_a, path_b] = Side.of(tokenizers_encoder(path_a), spelt), Side.of(pieces, pieces.spelt)
    return _sides[path_a, path_b]


# -- groups and links ------------------------------------------------------------------------------------------------------


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval: sorted by start, a group ends where a start reaches the running maximum of the ends."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


class Aligned:
    """The groups of a list of texts (null: empty). Offsets count bytes of all right texts one after another, each with its space."""

    def __init__(self, texts: list[str | None], a: Side, b: Side):
        self.size = len(texts)
        held = np.array([bool(t) for t in texts], dtype=bool)
        spaced = [" " + t for t in texts if t]
        truth = [t.encode() for t in spaced]
        (ids_a, at_a), (ids_b, at_b) = a.encode(spaced), b.encode(spaced)
        good = a.spelled_right(ids_a, at_a, truth) & b.spelled_right(ids_b, at_b, truth)
        of = np.flatnonzero(held)[good]
        ids, docs, ends, starts = [], [], [], []
        for side, found, at in ((a, ids_a, at_a), (b, ids_b, at_b)):
            n = np.diff(at)[good]
            own = found[ranges(at[:-1][good], n)]
            end = np.cumsum(side.length[own])
            ids.append(own)
            docs.append(np.repeat(of, n))
            ends.append(end)
            starts.append(end - side.length[own])
        self.n_a, self.n_b = (np.bincount(d, minlength=self.size) for d in docs)
        self.ids, self.doc = np.concatenate(ids), np.concatenate(docs)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.side = np.repeat(np.array([0, 1]), [len(x) for x in ids])
        self.group = coalesce(self.starts, self.ends)
        count = int(self.group.max()) + 1 if len(self.group) else 0
        self.of_group = np.zeros(count, dtype=np.int64)
        self.of_group[self.group] = self.doc
        self.tokens = [np.bincount(self.group[self.side == s], minlength=count) for s in (0, 1)]
        self.n_groups = np.bincount(self.of_group, minlength=self.size)
        self.n_links = np.zeros(self.size, dtype=np.int64)
        np.add.at(self.n_links, self.of_group, self.tokens[0] * self.tokens[1])

    def spelled(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids of its groups in decimal digits."""
        order = np.lexsort((self.starts, self.side, self.group))
        ids, side, group, doc = self.ids[order], self.side[order], self.group[order], self.doc[order]
        digits = [str(i).encode() for i in range(int(ids.max()) + 1)] if len(ids) else []
        size = np.fromiter(map(len, digits), np.int64, len(digits))
        flat = np.frombuffer(b"".join(digits), dtype=np.uint8)
        n = size[ids]
        out = np.empty(int(n.sum()) + len(ids), dtype=np.uint8)
        first = np.cumsum(n + 1) - (n + 1)
        out[ranges(first, n)] = flat[ranges((np.cumsum(size) - size)[ids], n)]
        mark = np.full(len(ids), ord(";"), dtype=np.uint8)
        if len(ids):
            same = group[1:] == group[:-1]
            mark[:-1][same] = np.where(side[1:][same] == side[:-1][same], ord(","), ord("|"))
        out[first + n] = mark
        total = np.append(0, np.cumsum(n + 1))[np.searchsorted(doc, np.arange(self.size + 1))]
        raw = out.tobytes()
        return [raw[x : max(x, y - 1)] for x, y in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) of all distinct linked id pairs of each text; a pair is A's id << 20 | B's id."""
        distinct = []
        for s in (0, 1):
            own = self.side == s
            key, n = np.unique((self.group[own] << _SHIFT) | self.ids[own], return_counts=True)
            distinct.append((key >> _SHIFT, key & _ID, n))
        (group_a, id_a, times_a), (group_b, id_b, times_b) = distinct
        first = np.searchsorted(group_b, group_a)
        width = np.searchsorted(group_b, group_a, "right") - first
        cuts = np.searchsorted(np.cumsum(width), np.arange(EXPAND, int(width.sum()) + 1, EXPAND))
        found = []
        for low, high in zip(np.append(0, cuts), np.append(cuts, len(width)), strict=True):
            n = width[low:high]
            b = ranges(first[low:high], n)
            pair = np.repeat(id_a[low:high], n) << _SHIFT | id_b[b]
            found.append(_summed(np.repeat(self.of_group[group_a[low:high]], n), pair, np.repeat(times_a[low:high], n) * times_b[b]))
        return found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _summed(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (doc, pair) rows as one."""
    order = np.lexsort((pair, doc))
    doc, pair, times = doc[order], pair[order], times[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    return doc[at], pair[at], np.add.reduceat(times, at) if len(at) else times


# -- Spark -----------------------------------------------------------------------------------------------------------------


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group: ``id_col``, nth (from 0), start and end (bytes of space and text), a and b (its ids)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = sides(path_a, path_b)
        for batch in batches:
            for low, high, _, _ in slices(batch.column("text")):
                x = Aligned(batch.column("text").slice(low, high - low).to_pylist(), *both)
                order = np.lexsort((x.starts, x.side, x.group))
                lists = {}
                for s, name in ((0, "a"), (1, "b")):
                    own = order[x.side[order] == s]
                    offsets = pa.array(np.append(0, np.cumsum(x.tokens[s])), pa.int32())
                    lists[name] = pa.ListArray.from_arrays(offsets, pa.array(x.ids[own], pa.int32()))
                count = len(x.of_group)
                start, end = np.full(count, np.iinfo(np.int64).max), np.zeros(count, dtype=np.int64)
                np.minimum.at(start, x.group, x.starts)
                np.maximum.at(end, x.group, x.ends)
                first = np.searchsorted(x.of_group, x.of_group)
                yield {
                    "id": batch.column("id").take(pa.array(low + x.of_group)), "nth": np.arange(count) - first,
                    "start": start - start[first], "end": end - start[first],
                } | lists

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, nth long, start long, end long, a array<int>, b array<int>").withColumnRenamed("id", id_col)


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x, dtype="<i8"), codec="zstd", asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, decompressed_size=8 * n, codec="zstd"), dtype="<i8")


def _blocks(rows: DataFrame, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    """A row per document: its numbers, and its distinct pairs as places in the list of its block, which stands in the block's first row."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = sides(path_a, path_b)
        block = TaskContext.get().partitionId() << 33
        waiting: list[tuple] = []
        size = 0

        def flush() -> dict:
            pairs = np.concatenate([p for _, _, found in waiting for _, p, _ in [found]])
            known, where = np.unique(pairs, return_inverse=True)
            docs = np.bincount(where, minlength=len(known))
            held, at, times, done = [], [], [], 0
            for ids, _, (doc, pair, n) in waiting:
                bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
                own = where[done : done + len(pair)]
                done += len(pair)
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    held.append(y - x)
                    at.append(_packed(np.diff(own[x:y], prepend=0)))
                    times.append(_packed(n[x:y]))
            rows = len(held)
            return {
                "id": pa.concat_arrays([ids for ids, _, _ in waiting]), "block": np.full(rows, block),
                **{c: np.concatenate([numbers[c] for _, numbers, _ in waiting]) for c in ("n_a", "n_b", "n_groups", "n_links")},
                "groups_sha256": pa.array([s for _, numbers, _ in waiting for s in numbers["sha"]]),
                "held": np.array(held), "at": pa.array(at, pa.binary()), "times": pa.array(times, pa.binary()),
                "pairs": pa.array([known, *[None] * (rows - 1)], pa.list_(pa.int64())),
                "docs": pa.array([docs, *[None] * (rows - 1)], pa.list_(pa.int64())),
            }

        for batch in batches:
            for low, high, data, _ in slices(batch.column("text")):
                x = Aligned(batch.column("text").slice(low, high - low).to_pylist(), *both)
                sha = [hashlib.sha256(s).hexdigest() if s else "" for s in x.spelled()]
                numbers = {"n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups, "n_links": x.n_links, "sha": sha}
                waiting.append((batch.column("id").slice(low, high - low), numbers, x.pairs()))
                size += len(data)
                if size >= block_bytes:
                    yield flush()
                    waiting.clear()
                    block, size = block + 1, 0
        if waiting:
            yield flush()

    schema = f"id {kind}, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held long, at binary, times binary, pairs array<long>, docs array<long>"
    return map_batches(rows, run, schema)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, docs): each block's distinct pairs and the number of its documents that hold them."""
    listed = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x"))
    return listed.select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))


def _counts(blocks: DataFrame) -> DataFrame:
    return _block_pairs(blocks).groupBy("pair").agg(F.sum("docs").alias("count"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, count: in how many documents the ids are linked."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = _counts(_blocks(rows, path_a, path_b, BLOCK_BYTES))
    return counts.select(F.shiftright("pair", _SHIFT).alias("a"), F.col("pair").bitwiseAND(_ID).alias("b"), "count")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col``, n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their A id), count_sum (over all
    links) and groups_sha256 of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = written(_blocks(rows, path_a, path_b, block_bytes), "aligned")
    counts = written(_counts(blocks).withColumn("a", F.shiftright("pair", _SHIFT)), "pair-counts")
    # one row per id of side A at most, an id being below 2**20
    highest = F.broadcast(counts.groupBy("a").agg(F.max("count").alias("highest")))
    judged = counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    known = _block_pairs(blocks).select("block", "place", "pair").join(judged, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    own = blocks.select("id", "block", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held", "at", "times")

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        count, best = np.zeros(found.num_rows, dtype=np.int64), np.zeros(found.num_rows, dtype=bool)
        place = found.column("place").to_numpy()
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        n_best, total = [], []
        for n, at, times in zip(*(texts.column(c).to_pylist() for c in ("held", "at", "times")), strict=True):
            where, links = np.cumsum(_unpacked(at, n)), _unpacked(times, n)
            n_best.append(int(links[best[where]].sum()))
            total.append(int((links * count[where]).sum()))
        kept = texts.select(["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    result = own.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(finish, schema)
    return result.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
