"""Importance resampling towards a target distribution, with segment dedup.

A text's features are its runs of one to three words, hashed into buckets by crc32. Corpus and target each give counts per bucket;
a bucket's gain is the scaled log ratio of its smoothed shares, a text's weight the sum of its features' gains. The texts
with the highest weight plus Gumbel noise are drawn: sampling without replacement in proportion to the ratios.

Segment dedup: line breaks part words, so a text is cut into lines, and only the runs over a line break depend on which
lines meet. A task gathers blocks of documents until their distinct lines reach ``BLOCK_BYTES``; features of each distinct line
are computed once per block and multiplied by the line's occurrences, in the corpus and in each text; the runs over
line breaks are added from the first two and last two words of each line. Texts are read twice, for counts and for weights,
and shuffle nothing: tasks hand out one count per bucket.

crc32 of a run follows from the words': shifting a checksum by the next word's length is linear, so it is four
table lookups, for all runs of a block at once.

Ranks come from sorted ranges of (score, id): the ranges' sizes shift the places inside them.

Cases: null and empty texts have no words, no features and weight 0; repeated rows count and are drawn each; a null id is hashed as an empty
one and comes last among ties; with no target texts, or no documents, counts are 0; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.frames import bounded_rows, map_batches, written
from evalspark.llm.words import Words, ranges, slices

BLOCK_BYTES = 4_000_000  # distinct lines of a block
BLOCK_LINES = 1_000_000  # lines of a block, repeated ones included
_POLYNOMIAL = 0xEDB88320  # crc32, fixed value
_NEAR = 64  # words up to this length have tables of their own

# a word is a run of [0-9a-z] and bytes above 0x7F, after A-Z is lower-cased
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x30:0x3A] = _INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


_BYTES = _byte_table()


def _step(c: np.ndarray) -> np.ndarray:
    """A checksum shifted by one zero byte."""
    return _BYTES[c & np.uint32(255)] ^ (c >> np.uint32(8))


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """[length, byte place, byte]: shifts by 0 to 65 bytes, and by powers of two."""
    here = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    near = [here]
    for _ in range(_NEAR + 1):
        near.append(_step(near[-1]))
    doubled = [near[1]]
    for _ in range(31):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.array(near), np.array(doubled)


def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & np.uint32(255)] ^ table[1][(c >> np.uint32(8)) & np.uint32(255)] ^ table[2][(c >> np.uint32(16)) & np.uint32(255)] ^ table[3][c >> np.uint32(24)]


_SHIFTS, _DOUBLED = _shift_tables()
_BLANK = np.uint32(zlib.crc32(b" "))


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums shifted by ``n`` bytes each, so that shifted(crc(x), len(y)) ^ crc(y) is crc(x + y)."""
    near = np.minimum(n, _NEAR + 1)
    found = _SHIFTS[near, 0, c & np.uint32(255)] ^ _SHIFTS[near, 1, (c >> np.uint32(8)) & np.uint32(255)]
    found ^= _SHIFTS[near, 2, (c >> np.uint32(16)) & np.uint32(255)] ^ _SHIFTS[near, 3, c >> np.uint32(24)]
    far = np.flatnonzero(n > _NEAR + 1)
    if len(far):
        left, value = n[far], c[far]
        for bit in range(int(left.max()).bit_length()):
            value = np.where((left >> bit) & 1, _apply(_DOUBLED[bit], value), value)
        found[far] = value
    return found


def word_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end]."""
    length = ends - starts
    order = np.argsort(-np.minimum(length, _NEAR + 1), kind="stable")
    at, size = starts[order], length[order]
    near = int(np.searchsorted(-size, -_NEAR))  # the words before are longer
    found = np.empty(len(starts), dtype=np.uint32)
    far = order[:near]
    found[far] = [zlib.crc32(data[a:b]) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    at, size, order = at[near:], size[near:], order[near:]
    value = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
    held = len(at) - np.searchsorted(size[::-1], np.arange(_NEAR), "right")  # words longer than j
    for j, n in enumerate(held.tolist()):
        if not n:
            break
        value[:n] = _BYTES[(value[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ (value[:n] >> np.uint32(8))
    found[order] = value ^ np.uint32(0xFFFFFFFF)
    return found


class Block:
    """Documents as lists of places in a list of distinct lines."""

    def __init__(self):
        self.places: dict[bytes, int] = {}
        self.sequence: list[int] = []  # the lines of all documents one after another
        self.counts: list[int] = []  # lines of each document
        self.bytes = 0

    def add(self, text: bytes) -> None:
        lines = text.split(b"\n")
        before = len(self.places)
        self.sequence += [self.places.setdefault(line, len(self.places)) for line in lines]
        self.counts.append(len(lines))
        if len(self.places) > before:
            self.bytes += len(text)

    @property
    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.sequence) >= BLOCK_LINES

    def features(self, buckets: int) -> BlockFeatures:
        return BlockFeatures(self, buckets)


class BlockFeatures:
    """The buckets of all features of a block: those of its distinct lines, and those over line breaks."""

    def __init__(self, block: Block, buckets: int):
        lines = list(block.places)
        joined = np.frombuffer(b"".join(lines), dtype=np.uint8)
        offsets = np.append(0, np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))))
        w = Words(joined, offsets, lower=True, inside=_INSIDE)
        self.buckets = buckets
        self.sequence = np.array(block.sequence, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(block.counts)), block.counts)
        self.words = w.counts
        self.n_words = np.bincount(self.doc, weights=self.words[self.sequence], minlength=len(block.counts)).astype(np.int64)
        self.crc = word_checksums(w.data, w.starts, w.ends)
        self.size = w.ends - w.starts
        self.after = shifted(np.full(len(self.crc), _BLANK), self.size) ^ self.crc  # of a blank and the word

        line = np.repeat(np.arange(len(lines)), self.words)
        inner = [(line, self.crc)]
        i = np.flatnonzero(line[1:] == line[:-1])
        two = self._longer(self.crc[i], i + 1)
        inner.append((line[i], two))
        three = line[i[:-1]] == line[i[:-1] + 2] if len(i) else np.zeros(0, dtype=bool)
        # neighbours in i that follow one another and stay in a line
        three &= i[1:] == i[:-1] + 1
        k = np.flatnonzero(three)
        inner.append((line[i[k]], self._longer(two[k], i[k] + 2)))
        self.inner_line = np.concatenate([x for x, _ in inner])
        self.inner = np.concatenate([x for _, x in inner]) % np.uint32(buckets)

        # the words next to line breaks: all of a line up to four words, else two at each end and a gap between
        count = self.words[self.sequence]
        held = np.minimum(count, 4)
        of = np.repeat(np.arange(len(self.sequence)), held)
        j = ranges(np.zeros(len(held), dtype=np.int64), held)
        long = count[of] > 4
        word = w.first[:-1][self.sequence][of] + j + np.where(long & (j >= 2), count[of] - 4, 0)
        gap = long & (j == 1)
        doc = self.doc[of]
        i = np.flatnonzero((doc[1:] == doc[:-1]) & (of[1:] != of[:-1]))
        outer = [(doc[i], self._longer(self.crc[word[i]], word[i + 1]))]
        i = np.flatnonzero((doc[2:] == doc[:-2]) & (of[2:] != of[:-2]) & ~gap[:-2] & ~gap[1:-1]) if len(of) > 2 else i[:0]
        outer.append((doc[i], self._longer(self._longer(self.crc[word[i]], word[i + 1]), word[i + 2])))
        self.outer_doc = np.concatenate([x for x, _ in outer])
        self.outer = np.concatenate([x for _, x in outer]) % np.uint32(buckets)

    def _longer(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Checksums of runs with a blank and one more word behind."""
        return shifted(crc, self.size[word] + 1) ^ self.after[word]

    def counts(self) -> np.ndarray:
        """Features per bucket: each distinct line's times its occurrences, and those over line breaks."""
        times = np.bincount(self.sequence, minlength=len(self.words))
        found = np.bincount(self.inner, weights=times[self.inner_line], minlength=self.buckets)
        return found.astype(np.int64) + np.bincount(self.outer, minlength=self.buckets)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """The sum of its features' gains for each document. Sums of whole numbers below 2**53 are exact."""
        line = np.bincount(self.inner_line, weights=gains[self.inner], minlength=len(self.words))
        found = np.bincount(self.doc, weights=line[self.sequence], minlength=len(self.n_words))
        return (found + np.bincount(self.outer_doc, weights=gains[self.outer], minlength=len(self.n_words))).astype(np.int64)

    @property
    def n_features(self) -> np.ndarray:
        n = self.n_words
        return n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[list, BlockFeatures]]:
    """(ids, features) of successive blocks of a task's documents."""
    block, ids = Block(), []
    for b in batches:
        for low, high, data, offsets in slices(b.column("text")):
            raw = data.tobytes()
            own = b.column("id").slice(low, high - low) if "id" in b.schema.names else None
            first = 0
            for i, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                block.add(raw[x:y])
                if block.full:
                    if own is not None:
                        ids.append(own.slice(first, i + 1 - first))
                    yield ids, block.features(buckets)
                    block, ids, first = Block(), [], i + 1
            if own is not None:
                ids.append(own.slice(first))
    if block.counts:
        yield ids, block.features(buckets)


def bucket_counts(texts: DataFrame, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """bucket, n: the number of features in each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, features in _blocks(batches, buckets):
            total += features.counts()
        some = np.flatnonzero(total)
        yield {"bucket": some, "n": total[some]}

    found = map_batches(texts.select(F.col(text_col).alias("text")), run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln(share in the target / share in the corpus)) of each bucket, shares smoothed by one per bucket."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    ratio = [float(target.get(b, 0) + 1) * s_all / (float(corpus.get(b, 0) + 1) * t_all) for b in range(buckets)]
    return np.array([math.floor(scale * math.log(x)) for x in ratio], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, features in _blocks(batches, len(gain)):
            yield {"id": pa.concat_arrays(ids), "n_words": features.n_words, "n_features": features.n_features, "weight": features.weights(gain)}

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = 10_000, seed: int = 42,
    scale: int = 1000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id_col``, n_features, weight, score and rank (null: not drawn) of every document."""
    spark = docs.sparkSession
    # one row per bucket at most
    corpus = {r["bucket"]: r["n"] for r in bounded_rows(bucket_counts(docs, buckets, text_col), buckets)}
    wanted = {r["bucket"]: r["n"] for r in bounded_rows(bucket_counts(target, buckets, text_col), buckets)}
    weighed = weigh(docs, gains(corpus, wanted, buckets, scale), id_col, text_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, "scored")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * share[0] // share[1]
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = eligible.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed.withColumn("range", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND(2**33 - 1)), "placed")
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    # a row per sorted range, whose number is a setting
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = F.broadcast(sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before")))
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(shifts, "range").withColumn("rank", F.when(rank <= drawn, rank))
    other = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionByName(other.select(columns))
