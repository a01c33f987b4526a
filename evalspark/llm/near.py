"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct word n-grams, each a 64-bit hash. Two sets are linked if their overlap is at
least ``num / den`` of their union; then they differ in at most D = floor(a * (den - num) / num) elements, a being
the size of the smaller one.

* Sizes are cut into classes. A class deals elements into k, some 2 D, parts by hash and XORs the hashes of each part:
  one differing element changes one part, so by the pigeonhole principle k - D parts agree. A set takes part in its own
  class and, if it can be the larger one of a pair, in the class below.
* Under any one order of all parts, the first part that two linked sets have in common is among the first D + 1 of each, for no
  more than D of a set's parts are not common to both. So a set hands out only its D + 1 first parts, rare ones before
  frequent ones: what a common passage or license line makes up is left out, and unrelated texts don't meet. The order
  is by counts over all texts: tasks count parts in windows of ``WINDOW`` and hand out those met twice, the ``HEAVY``
  most frequent of their sums are known to every task, others count as rare. Parts without elements come last.
* A second sketch of 512 bits flips one bit per element. Its Hamming distance never exceeds the number of
  differing elements, so pairs beyond D are dropped before their texts are fetched.
* The rest is verified on the whole sets. Only sets that share a part with another hand out their texts: they are marked in a bitmap
  of a fixed size, and a pass of its own over the texts writes theirs. One row per set is picked by its number.

Groups of sets that share a part are not expanded into pairs. Equal sets are one class from the start. Then each
member of a group is compared with the group's smallest member only; the links found give components.
While the groups that still hold several components would make many more pairs than they have members, their members are
compared with a few further members each, the smallest ones under other orders, and the components are merged (once by default).
What is left is joined once more, members of different components only and under the Hamming bound. All pairs of different
components that share a part have then been compared, so no link between components is missed, however the rounds end.

Cases: null and empty texts, and texts without words, have no set and are linked with nothing; a text
with fewer words than n is one n-gram; repeated rows are linked with each other; other columns are not
read; no rows give no rows. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.components import components
from evalspark.llm.frames import bounded_rows, map_batches, written
from evalspark.llm.words import Words, mix, signed, slices

SKETCH = 512
HEAVY = 100_000  # frequent parts that every task knows
WINDOW = 1_000_000  # parts that a task counts together
CENTRES = 2  # members of an open group that the others are compared with in a round
SPARE = 4  # pairs a member beyond which another round is worth its cost
ROUNDS = 1  # at most; they only decide how much the last join compares
SLICE = 250_000  # bytes of texts worked on together: arrays of this size stay in a core's cache
BITS = 25  # of a set's name, that mark it among those which share a part
SEEN = 200_000  # sets that a task remembers in order not to repeat them; beyond that it starts anew
_SEED = np.uint64(0xA0761D6478BD642F)


class Rule:
    """Size classes and their number of parts for n-grams of ``words`` words and a similarity of num / den."""

    def __init__(self, words: int, num: int, den: int):
        if not 0 < num < den:
            raise ValueError("the similarity must lie between 0 and 1")
        self.words, self.num, self.den = words, num, den

    def differing(self, size: int) -> int:
        """Most elements in which a set of this size and a larger one that is linked with it can differ."""
        return size * (self.den - self.num) // self.num

    def bounds(self, size: int) -> tuple[int, int, int]:
        """(number, smallest, largest size) of the class of ``size``."""
        low = next(s for s in range(1, self.num + 1) if self.differing(s) > 0) if self.num >= self.den - self.num else 1
        number = 1
        if size < low:
            return 0, 1, low - 1
        while True:  # a class spans at least two factors of den / num, so a pair spans two classes at most
            above = max(low + 1, -(-low * self.den * self.den // (self.num * self.num)))
            if size < above:
                return number, low, above - 1
            number, low = number + 1, above

    def classes(self, size: int) -> list[tuple[int, int, int]]:
        """(class, most differing elements, parts) of the classes a set of ``size`` takes part in."""
        number, low, top = self.bounds(size)
        found = []
        for c, t in ((number, top), (number - 1, low - 1)):
            most = self.differing(t) if t > 0 else 0
            if c > 0 and most > 0 and (c == number or size * self.num <= t * self.den):
                found.append((c, most, 2 * most + 1))
        return found


def sets(w: Words, n: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct n-grams of each text."""
    starts, count = w.run_starts(n)
    grams = w.runs(starts, n)
    ends = np.cumsum(count)
    found = []
    for i, (words, a, b) in enumerate(zip(w.counts.tolist(), (ends - count).tolist(), ends.tolist(), strict=True)):
        if words >= n:
            own = np.sort(grams[a:b])
            found.append(own[np.append(True, own[1:] != own[:-1])])
        elif words:
            found.append(mix(w.runs(w.first[i : i + 1], words) + np.uint64(words)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def identities(found: list[np.ndarray]) -> list[int]:
    """A 64-bit name of each set, by one pass over the elements of all."""
    ends = np.cumsum([0, *map(len, found)])
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(mix(np.concatenate(found) ^ _SEED), dtype=np.uint64)) if found else np.zeros(1, np.uint64)
        sums = total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64)
    return signed(mix(sums)).tolist()


def sketch(grams: np.ndarray) -> np.ndarray:
    """Eight longs: each element flips one of 512 bits."""
    bits = (np.bincount((mix(grams) >> np.uint64(55)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)
    return np.packbits(bits).view(">i8").astype(np.int64)


@lru_cache(maxsize=1000)
def _places(c: int, k: int) -> np.ndarray:
    return mix(np.arange(k, dtype=np.uint64) + np.uint64(c << 40))


def parts(grams: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(keys of all parts, which of them hold elements, most differing elements) per class of the set."""
    found = []
    for c, most, k in rule.classes(len(grams)):
        spread = mix(grams + np.uint64(c * int(_SEED) % 2**64))
        part = (((spread >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        value = np.zeros(k, dtype=np.uint64)
        np.bitwise_xor.at(value, part, grams)
        held = np.bincount(part, minlength=k) > 0
        found.append((signed(mix(value ^ _places(c, k))), held, most))
    return found


class Frequent:
    """The most frequent parts and their counts, by which parts are ordered."""

    def __init__(self, keys: list[int], counts: list[int]):
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.counts = np.array(keys, dtype=np.int64)[order], np.array(counts, dtype=np.int64)[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0)


def handed_out(grams: np.ndarray, rule: Rule, frequent: Frequent) -> np.ndarray:
    """The D + 1 rarest parts of each class of the set."""
    found = [keys[np.lexsort((keys, frequent(keys), ~held))[: most + 1]] for keys, held, most in parts(grams, rule)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _sets_and_counts(rows: DataFrame, rule: Rule, kind: str) -> tuple[DataFrame, Frequent]:
    """(id, n, set) of each row, and counts of parts over all texts, equal sets of a task counted once.

    Both come from one pass over the texts: count rows have no set and set rows no key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting: list[np.ndarray] = []
        size = 0
        seen: set[int] = set()
        ids = None
        for b in batches:
            for low, high, data, offsets in slices(b.column("text"), SLICE):
                found = sets(Words(data, offsets, lower=True), rule.words)
                names = identities(found)
                ids = b.column("id").slice(low, high - low)
                none = pa.nulls(len(found), pa.int64())
                yield {"id": ids, "n": pa.array([len(s) for s in found], pa.int64()), "set": pa.array(names, pa.int64()), "key": none, "times": none}
                for grams, name in zip(found, names, strict=True):
                    if len(grams) and name not in seen:
                        seen.add(name)
                        own = [keys[held] for keys, held, _ in parts(grams, rule)]
                        waiting += own
                        size += sum(map(len, own))
                    if size >= WINDOW:
                        yield _repeated(waiting, ids.type)
                        waiting, size, seen = [], 0, set()
        if waiting:
            yield _repeated(waiting, ids.type)

    both = written(map_batches(rows, run, f"id {kind}, n long, set long, key long, times long"), "sets")
    counted = both.where("key is not null").groupBy("key").agg(F.sum("times").alias("n"))
    top = bounded_rows(counted.orderBy(F.desc("n"), "key").limit(HEAVY), HEAVY)
    return both.where("set is not null").select("id", "n", "set"), Frequent([r["key"] for r in top], [r["n"] for r in top])


def _repeated(waiting: list[np.ndarray], kind: pa.DataType) -> dict:
    keys, n = np.unique(np.concatenate(waiting), return_counts=True)
    keys, n = keys[n > 1], n[n > 1]
    none = pa.nulls(len(keys), pa.int64())
    return {"id": pa.nulls(len(keys), kind), "n": none, "set": none, "key": pa.array(keys, pa.int64()), "times": pa.array(n, pa.int64())}


def _once_per_task(docs: DataFrame, rule: Rule, rows, schema: str, bitmap=None) -> DataFrame:
    """``rows`` (a generator over identity, set and text) for each set that a task does not remember to have met; with a
    ``bitmap`` for sets marked there only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()
        for b in batches:
            for _, _, data, offsets in slices(b.column("text"), SLICE):
                w = Words(data, offsets, lower=True)
                fresh = []
                found = sets(w, rule.words)
                names = identities(found)
                wanted = [True] * len(names) if bitmap is None else _marked(names, bitmap.value)
                for i, (grams, name) in enumerate(zip(found, names, strict=True)):
                    if len(grams) and wanted[i] and name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        fresh.append((name, grams, w.text_of(i)))
                if fresh:
                    yield rows(fresh)

    return map_batches(docs.select("text"), run, schema)


def _bitmap(named: DataFrame) -> np.ndarray:
    """The first ``BITS`` bits of every ``set``, marked; each task brings its words together first."""
    slot = F.shiftrightunsigned("set", 64 - BITS)
    marks = named.select(F.shiftright(slot, 6).alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    words = marks.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = np.zeros(2 ** (BITS - 6), dtype=np.uint64)
    for r in bounded_rows(words, 2 ** (BITS - 6)):
        bits[r["word"]] = np.uint64(r["bits"] % 2**64)
    return bits


def _marked(names: list[int], bits: np.ndarray) -> list[bool]:
    slot = np.array(names, dtype=np.int64).view(np.uint64) >> np.uint64(64 - BITS)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool).tolist()


def _linked(pairs: DataFrame, marks: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of sets that are linked, verified on whole sets.

    ``texts`` may have a set several times; ``marks`` has the number of the one row to take.
    """
    left = marks.select(*[F.col(c).alias(f"a_{c}") for c in marks.columns])
    right = marks.select(*[F.col(c).alias(f"b_{c}") for c in marks.columns])
    near = pairs.join(left, F.col("a") == F.col("a_set")).join(right, (F.col("b") == F.col("b_set")) & _may_link(rule))
    both = near.select("a", "b", "a_row", "b_row")
    for side in ("b", "a"):
        body = texts.select(F.col("set").alias(side), F.col("row").alias(f"{side}_row"), F.col("body").alias(f"{side}_body"))
        both = both.join(body, [side, f"{side}_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for a, b, x, y in _blocks(*(batch.column(c).to_pylist() for c in ("a", "b", "a_body", "b_body"))):
                first = {name: i for i, name in enumerate(a)}  # a text stands next to all its partners
                firsts = dict(zip(first, _sets_of([zlib.decompress(x[i]) for i in first.values()], rule), strict=True))
                hit = []
                for name, other in zip(a, _sets_of(y, rule), strict=True):
                    one = firsts[name]
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    hit.append(rule.den * common >= rule.num * (len(one) + len(other) - common))
                yield {"a": pa.array(a, pa.int64()).filter(pa.array(hit)), "b": pa.array(b, pa.int64()).filter(pa.array(hit))}

    return map_batches(both.select("a", "b", "a_body", "b_body"), run, "a long, b long")


def _blocks(a: list[int], b: list[int], x: list[bytes], y: list[bytes]) -> Iterator[tuple[list, ...]]:
    """The pairs by runs of some ``SLICE`` bytes of second texts, these unpacked."""
    raw: list[bytes] = []
    size = low = 0
    for i, packed in enumerate(y):
        raw.append(zlib.decompress(packed))
        size += len(raw[-1])
        if size >= SLICE or i + 1 == len(y):
            yield a[low : i + 1], b[low : i + 1], x[low : i + 1], raw
            raw, size, low = [], 0, i + 1


def _sets_of(raw: list[bytes], rule: Rule) -> list[np.ndarray]:
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    return sets(Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, lower=True), rule.words)


def _may_link(rule: Rule):
    """The size and Hamming bounds on the columns a_n, a_s0..a_s7 and b_n, b_s0..b_s7."""
    distance = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(8)])
    # overlap >= num / den of the union: differing elements <= (den - num) / (den + num) of both sizes
    return (
        (F.col("a_n") * rule.den >= F.col("b_n") * rule.num)
        & (F.col("b_n") * rule.den >= F.col("a_n") * rule.num)
        & (distance * (rule.den + rule.num) <= (F.col("a_n") + F.col("b_n")) * (rule.den - rule.num))
    )


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(set, root) after further links."""
    stars = roots.select(F.col("set").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(links)).select(F.col("node").alias("set"), "root")


def _open_rows(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, set, root) of the groups with several components, but for their smallest members: these were compared with all."""
    placed = shared.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    return placed.join(mixed, "key", "left_semi").where("set != low").select("key", "set", "root").distinct()


def _worth_a_round(open_rows: DataFrame) -> bool:
    """Whether all pairs of different components would be many more than the rows of the open groups."""
    n = F.col("n").cast("double")
    by_root = open_rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    by_key = by_root.groupBy("key").agg(F.sum("n").alias("rows"), (F.sum(n) * F.sum(n) - F.sum(n * n)).alias("pairs"))
    total = by_key.agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).first()
    return (total["pairs"] or 0.0) / 2 > SPARE * (total["rows"] or 0)


def _with_centres(open_rows: DataFrame, roots: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of a group's centres with its members of other components; an order is a constant that ids are XORed with."""
    orders = [int(x) for x in signed(mix(np.arange(CENTRES, dtype=np.uint64) + np.uint64(1 + number * CENTRES)))]
    least = open_rows.groupBy("key").agg(*[F.min(F.col("set").bitwiseXOR(F.lit(x))).alias(f"c{i}") for i, x in enumerate(orders)])
    chosen = F.array_distinct(F.array(*[F.col(f"c{i}").bitwiseXOR(F.lit(x)) for i, x in enumerate(orders)]))
    centres = least.select("key", F.explode(chosen).alias("centre"))
    centres = centres.join(roots.select(F.col("set").alias("centre"), F.col("root").alias("its")), "centre", "left")
    centres = written(centres.select("key", "centre", F.coalesce("its", "centre").alias("its")), "centres")
    both = open_rows.join(centres, "key").where("root != its")
    return both.select(F.least("centre", "set").alias("a"), F.greatest("centre", "set").alias("b")).distinct()


def link(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id (the smallest id reachable by links) of every row."""
    rule = Rule(words, *similarity)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    named, frequent = _sets_and_counts(rows, rule, kind)

    def handed(fresh: list) -> dict:
        own = [handed_out(grams, rule, frequent) for _, grams, _ in fresh]
        return {"key": np.concatenate(own), "set": np.repeat(np.array([x[0] for x in fresh], dtype=np.int64), [len(x) for x in own])}

    dealt = _once_per_task(rows, rule, handed, "key long, set long")
    group = Window.partitionBy("key")
    shared = dealt.select("key", "set", F.min("set").over(group).alias("low"), F.max("set").over(group).alias("high"))
    shared = written(shared.where("low != high").select("key", "set", "low"), "shared-parts")

    def marked_text(fresh: list) -> dict:
        marks = np.array([sketch(grams) for _, grams, _ in fresh])
        out = {"set": pa.array([x[0] for x in fresh], pa.int64()), "n": pa.array([len(x[1]) for x in fresh], pa.int64())}
        out |= {f"s{i}": np.ascontiguousarray(marks[:, i]) for i in range(8)}
        return out | {"body": pa.array([zlib.compress(x[2], 1) for x in fresh], pa.binary())}

    schema = "set long, n long, " + ", ".join(f"s{i} long" for i in range(8)) + ", body binary"
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(shared.select("set")))
    texts = _once_per_task(rows, rule, marked_text, schema, bitmap).withColumn("row", F.monotonically_increasing_id())
    texts = written(texts, "shared-texts")
    marks = written(texts.drop("body").dropDuplicates(["set"]), "marks")

    stars = shared.where("set != low").select(F.col("low").alias("a"), F.col("set").alias("b")).distinct()
    links = written(_linked(stars, marks, texts, rule), "links")
    roots = written(components(links), "roots").select(F.col("node").alias("set"), "root")

    # groups in which several components are left: members of different components, under the bounds
    for number in range(ROUNDS):
        open_rows = written(_open_rows(shared, roots), "open-rows")
        if not _worth_a_round(open_rows):
            break
        more = written(_linked(_with_centres(open_rows, roots, number), marks, texts, rule), "centre-links")
        if more.isEmpty():
            break
        roots = written(_merged(roots, more), "roots")
    else:
        open_rows = written(_open_rows(shared, roots), "open-rows")
    marked = written(open_rows.join(marks.drop("row"), "set"), "open-groups")
    side = lambda p: marked.select("key", *[F.col(c).alias(f"{p}_{c}") for c in marked.columns if c != "key"])
    again = side("a").join(side("b"), "key").where((F.col("a_root") < F.col("b_root")) & _may_link(rule))
    pairs = written(again.select(F.col("a_set").alias("a"), F.col("b_set").alias("b")).distinct(), "open-pairs")
    more = written(_linked(pairs, marks, texts, rule), "more-links")
    if not more.isEmpty():
        roots = _merged(roots, more)

    full = named.where("n > 0").join(roots, "set", "left").select("id", "n", F.coalesce("root", "set").alias("root"))
    least = full.groupBy("root").agg(F.min("id").alias("component_id"))
    found = full.join(written(least, "least-ids"), "root").select("id", "n", "component_id")
    empty = named.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
