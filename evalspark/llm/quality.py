"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are the words and pairs of words of a text, and the shapes of both (runs of small letters, capitals
and digits made one sign each, other characters kept; for pairs, whether words repeat), hashed into
``2**BITS`` buckets. A bucket's value
is its share of the text's features, so texts of any length are on one scale.

Training takes at most ``sample`` labelled rows (a documented bound), those with the smallest hash of
their id; they are shuffled into one task, which learns row by row. The weights, 2**BITS numbers whatever the
input, are what reaches the driver and goes to every task. Scoring is a sparse dot product per text.

Cases: null and empty texts have no features and get the score of the bias; labels that are null, other than
0 and 1, or as often 0 as 1 for one id are not learnt; without labels every score is 0.5; repeated rows are
scored each; columns that are not named are not read unless kept, and are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import bounded_rows, map_batches
from evalspark.llm.words import Words, mix, slices, spans_hash

BITS = 18
SCALE = 12.0
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
_KINDS = [np.uint64(0x517CC1B727220A95 * k % 2**64) for k in (1, 3, 5, 7)]


def _shape_hashes(w: Words, byte: np.ndarray) -> np.ndarray:
    shape = _SHAPE[w.data]
    new = np.empty(len(shape), dtype=bool)
    if len(shape):
        new[0] = True
        np.not_equal(shape[1:], shape[:-1], out=new[1:])
    new[w.starts] = True
    place = np.append(0, np.cumsum(new))
    return spans_hash(byte[shape[new]], place[w.starts], place[w.ends])


_BYTE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=np.uint64)


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, first feature of each text) for each kind of feature."""
    low = np.uint64(2**BITS - 1)
    found = []
    for k, one in enumerate((w.hashes, _shape_hashes(w, _BYTE))):
        found.append(((mix(one ^ _KINDS[2 * k]) & low).astype(np.int32), w.first))
        both = one[:-1] * np.uint64(3) + mix(one[1:]) + _KINDS[2 * k + 1]
        inside = np.ones(len(both), dtype=bool)
        edges = w.first[1:-1]
        inside[edges[(edges > 0) & (edges < len(one))] - 1] = False
        if k:  # a pair of shapes also says whether its first word comes again at once, or one word later
            both += (w.hashes[:-1] == w.hashes[1:]).astype(np.uint64)
            both[:-1] += ((w.hashes[:-2] == w.hashes[2:]) & inside[:-1] & inside[1:]).astype(np.uint64) * np.uint64(2)
        pairs = mix(both) & low
        place = np.append(0, np.cumsum(inside))
        found.append((pairs[inside].astype(np.int32), place[np.minimum(w.first, len(pairs))]))
    return found


def scores(w: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.zeros(len(w.offsets) - 1)
    n = np.zeros(len(w.offsets) - 1, dtype=np.int64)
    for buckets, first in features(w):
        sums = np.append(0.0, np.cumsum(weights[buckets], dtype=np.float64))
        total += sums[first[1:]] - sums[first[:-1]]
        n += np.diff(first)
    return 1 / (1 + np.exp(-np.clip(bias + SCALE * total / np.maximum(n, 1), -30, 30)))


class Leader:
    """Follow-the-regularised-leader with a learning rate per weight."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        after = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(after) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = after


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 6_000, passes: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[np.ndarray, float]:
    """(weights, bias) from at most ``sample`` labelled ids."""
    label = F.col(label_col).cast("int")
    known = (
        labels.filter(label.isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.avg(label).alias("mean"))
        .filter("mean != 0.5")
        .select("id", (F.col("mean") > 0.5).cast("int").alias("y"), F.xxhash64("id").alias("order"))
        .orderBy("order", "id")
        .limit(sample)
    )
    # the bound on the sample is one on what is broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for low, high, data, offsets in slices(b.column("text")):
                part = b.slice(low, high - low)
                kinds = features(Words(data, offsets))
                at, x = [], []
                for i in range(high - low):
                    own = np.concatenate([f[first[i] : first[i + 1]] for f, first in kinds])
                    bucket, n = np.unique(own, return_counts=True)
                    at.append(bucket.astype("<i4").tobytes())
                    x.append((SCALE * n / max(len(own), 1)).astype("<f4").tobytes())
                yield {"order": part.column("order"), "y": part.column("y"), "at": pa.array(at, pa.binary()), "x": pa.array(x, pa.binary())}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        leader = Leader()
        for _ in range(passes):
            for _, y, at, x in rows:
                places = np.append(np.frombuffer(at, "<i4"), 2**BITS)  # the bias is the last weight
                leader.learn(places, np.append(np.frombuffer(x, "<f4"), 1.0).astype(np.float64), y)
        yield {"weights": pa.array([leader.weights().astype("<f4").tobytes()], pa.binary())}

    gathered = map_batches(rows.select("text", "order", "y"), collect, "order long, y int, at binary, x binary")
    one = gathered.repartition(1).sortWithinPartitions("order", "y", "at", "x")
    found = bounded_rows(map_batches(one, learn, "weights binary"), 1)
    weights = np.frombuffer(found[0]["weights"], "<f4") if found else np.zeros(2**BITS + 1, np.float32)
    return weights[:-1], float(weights[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and the chance that a text is of quality."""
    weights, bias = model
    rows = docs.select(*keep, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [scores(Words(data, offsets), weights, bias) for _, _, data, offsets in slices(b.column("_text"))]
            yield {c: b.column(c) for c in keep} | {name: np.concatenate(found or [np.zeros(0)])}

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(rows, run, f"{types}, `{name}` double")


def held_out(id_col: str = "doc_id"):
    """Ids kept from training: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
