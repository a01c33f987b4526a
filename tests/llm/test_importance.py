"""Importance resampling against a plain version of the stated rule."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import llm_brute as B
import numpy as np
import pytest

from evalspark.llm import importance

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(rows, target, share=(5, 100), least=20, buckets=10_000):
    s = Counter(bucket(f, buckets) for _, t in rows for f in features(t))
    t = Counter(bucket(f, buckets) for x in target for f in features(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    found = []
    for i, text in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f, buckets)] for f in features(text))
        found.append([i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = [r for r, (_, text) in zip(found, rows, strict=True) if len(words(text)) >= least]
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * share[0] // share[1]]):
        r[4] = k + 1
    return [tuple(r) for r in found]


def texts(n, seed=1):
    rnd = random.Random(seed)
    some = ["Alpha", "beta", "γ", "x1", "12", "é", "don't", "a", "漢字", "-", "w" * 70, "z" * 130, "and"]
    lines = [" ".join(rnd.choices(some, k=rnd.randint(0, 7))) for _ in range(25)]
    return ["\n".join(rnd.choices(lines, k=rnd.randint(0, 9))) for _ in range(n)]


def test_checksums():
    rnd = random.Random(2)
    pieces = [bytes(rnd.choices(range(256), k=k)) for k in [0, 1, 2, 63, 64, 65, 66, 67, 500, 70_000, 3, 3]]
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    starts = ends - [len(p) for p in pieces]
    crc = importance.word_checksums(data, starts, ends)
    assert crc.tolist() == [zlib.crc32(p) for p in pieces]
    for x, y in [(3, 5), (8, 9), (1, 7), (4, 0)]:
        both = importance.shifted(crc[x : x + 1], np.array([len(pieces[y])])) ^ crc[y]
        assert int(both[0]) == zlib.crc32(pieces[x] + pieces[y])


@pytest.mark.parametrize("size", [1, 300, 4_000_000])
def test_blocks_count_all_runs(monkeypatch, size):
    monkeypatch.setattr(importance, "BLOCK_BYTES", size)
    import pyarrow as pa

    found = texts(80) + ["", "\n", "a", "a\n\n \nb", "a\nb\nc", "a b c d e\nf\ng h i j k l\n"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(found))), "text": found})
    total, ids = np.zeros(97, dtype=np.int64), []
    gain = np.arange(97) - 40
    for own, x in importance._blocks(iter([batch, batch]), 97):
        total += x.counts()
        own = [i for a in own for i in a.to_pylist()]
        ids += own
        assert x.n_features.tolist() == [len(features(found[i])) for i in own]
        assert x.weights(gain).tolist() == [sum(gain[bucket(f, 97)] for f in features(found[i])) for i in own]
    assert ids == list(range(len(found))) * 2
    want = Counter(bucket(f, 97) for t in found for f in features(t))
    assert total.tolist() == [2 * want[b] for b in range(97)]


def test_resample(sql, odd):
    more = [(100 + i, t) for i, t in enumerate(texts(300))] + [(500, "alpha beta " * 20_000), (501, "alpha beta " * 30), (501, "alpha beta " * 30)]
    docs = odd.select("doc_id", "text").unionByName(sql.createDataFrame(more, "doc_id long, text string")).repartition(5)
    target = ["alpha beta x1", "and 12\nalpha and", None, ""]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = importance.resample(docs, sql.createDataFrame([(t,) for t in target], "text string"), share=(30, 100))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got, want = [tuple(r) for r in found.collect()], plain(rows, target, share=(30, 100))
    assert B.by_text(r[:4] for r in got) == B.by_text(r[:4] for r in want)
    drawn = lambda x: sorted((r[4], r[0], r[3]) for r in x if r[4] is not None)
    assert drawn(got) == drawn(want) and len(drawn(got)) > 30


def test_no_rows_and_clashing_columns(sql, odd):
    target = sql.createDataFrame([("alpha",)], "text string")
    assert importance.resample(odd.where("false"), target).count() == 0
    clash = odd.withColumnsRenamed({"lang": "range", "n_chars": "place", "n": "n_words", "rank": "bucket"})
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert B.by_text(tuple(r) for r in importance.resample(clash, target.where("false")).collect()) == B.by_text(plain(rows, []))
