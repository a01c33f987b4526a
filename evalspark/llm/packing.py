"""Packing token sequences into as few bins as possible, planned on lengths.

Lengths are whole numbers up to the capacity, so the number of pieces of each length is all a plan needs:
at most ``capacity`` counts reach the driver, whatever the input. Pieces above a third of the capacity fit
at most twice into a bin and are matched greedily, the longest with the longest partner that fits. Smaller
pieces, longest first, go to the bin with the least gap that holds them. The plan is a list of
patterns with multiplicities; a piece finds its place by its rank among the pieces of its length, which the
tasks count as they write them.

Cases: a null or empty text has only the closing id; repeated rows are packed each; other columns are not
read; no rows give no rows; only documents longer than a sequence are cut, and all pieces but the first are full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.frames import bounded_rows, map_batches, written
from evalspark.llm.tokens import tokenizers_encoder
from evalspark.llm.words import slices


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one bin) and how many bins have them; work and size depend on capacity only."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] += n
    large = capacity // 3 + 1  # three of these don't fit
    by_gap: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for a in range(capacity, large - 1, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b >= large and (not left[b] or b == a and left[a] < 2):
                b -= 1
            if b < large:
                by_gap[capacity - a][(a,)] += left[a]
                left[a] = 0
            else:
                m = left[a] // 2 if a == b else min(left[a], left[b])
                by_gap[capacity - a - b][(a, b)] += m
                left[a] -= m
                left[b] -= m
    for s in range(min(large - 1, capacity), 0, -1):
        n = left[s]
        gap = s
        while n:
            while gap <= capacity and not by_gap.get(gap):
                gap += 1
            if gap > capacity:  # new bins, each filled with as many as it holds
                each = capacity // s
                if n >= each:
                    by_gap[capacity - each * s][(s,) * each] += n // each
                if n % each:
                    by_gap[capacity - (n % each) * s][(s,) * (n % each)] += 1
                break
            bins = by_gap[gap]
            pattern, have = next(iter(bins.items()))
            each = gap // s  # the same bins stay the tightest for this length until they are full
            full = min(have, n // each)
            if full:
                by_gap[gap - each * s][pattern + (s,) * each] += full
                n -= full * each
                bins[pattern] -= full
            else:
                by_gap[gap - n * s][pattern + (s,) * n] += 1
                bins[pattern] -= 1
                n = 0
            if not bins[pattern]:
                del bins[pattern]
    return [(p, m) for bins in by_gap.values() for p, m in sorted(bins.items()) if m]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of each place of each pattern."""
    rank: dict[int, int] = defaultdict(int)
    found = []
    sequence = 0
    for pattern, bins in patterns:
        offset = 0
        for length in pattern:
            found.append((length, rank[length], rank[length] + bins, sequence, offset))
            rank[length] += bins
            offset += length
        sequence += bins
    return found


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, its task and its number among the task's pieces
    of that length; ``ids`` too if asked for."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = tokenizers_encoder(path)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            for low, high, _, _ in slices(b.column("text")):
                ids, bounds = encoder.ids([t or "" for t in b.column("text").slice(low, high - low).to_pylist()])
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                close = np.array([end_id], dtype="<u4").tobytes()
                out: list[tuple] = []
                of: list[int] = []
                for i in range(high - low):
                    own = bytes(raw[4 * bounds[i] : 4 * bounds[i + 1]]) + close
                    total = len(own) // 4
                    at, end = 0, (total - 1) % capacity + 1 if total > capacity else total
                    piece = 0
                    while at < total:
                        part = own[4 * at : 4 * end]
                        n = end - at
                        out.append((piece, at, n, zlib.crc32(part), seen[n], part if with_ids else None))
                        of.append(low + i)
                        seen[n] += 1
                        at, end, piece = end, end + capacity, piece + 1
                cols = list(zip(*out, strict=True))
                yield {
                    "id": b.column("id").take(pa.array(of)),
                    "piece": pa.array(cols[0], pa.int32()), "start": pa.array(cols[1], pa.int64()), "length": pa.array(cols[2], pa.int64()),
                    "ids_crc32": pa.array(cols[3], pa.int64()), "task": pa.array([task] * len(of), pa.int32()), "nth": pa.array(cols[4], pa.int64()),
                } | ({"ids": pa.array(cols[5], pa.binary())} if with_ids else {})

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(
        rows, run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids
    )


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece at its place."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    per_task = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    lengths = per_task.groupBy("length").agg(F.sum("n").alias("n"))
    counts = {r["length"]: r["n"] for r in bounded_rows(lengths, capacity)}
    places = slots(plan(counts, capacity))
    # a row per place of a pattern: their number depends on the capacity alone
    placed = spark.createDataFrame(places, "length long, low long, high long, first long, offset long")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    found = ranked.join(F.broadcast(placed), "length").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []),
    )
