import random
import zlib

import llm_brute as B
import numpy as np
import public_tokenizers
import pytest
import tiktoken  # noqa: F401

from evalspark.llm import bpe, packing, tokens

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "'re", "'ll", "1", "²", "٣", "!", "漢", " ", "\x1c", "😀", "\0", "'t", "̀", "\U0001faea", "\r\n", "ſ"]


def plain(path):
    return tokens.tiktoken_encoder(path)[0] if path == RANKS else tokens.tokenizers_encoder(path)


@pytest.mark.parametrize("path", [RANKS, JSON])
def test_batches_encode_as_the_library_does(path):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 12))) for _ in range(4000)] + ["", "<|endoftext|>"]
    encoder = plain(path)
    ids, bounds = encoder.ids(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.many([text])[0], text
    assert encoder.ids([])[0].tolist() == []


def test_cuts_are_the_text():
    rnd = random.Random(2)
    for _ in range(300):
        text = "".join(rnd.choices(SIGNS, k=rnd.randint(1, 120)))
        size, overlap = rnd.randint(6, 30), rnd.randint(1, 5)
        n = -(-len(text) // size)
        parts = [bpe.cut(text[c * size : c * size + size + overlap], c, size, overlap, c == n - 1) for c in range(n)]
        assert "".join("".join(p) for p in parts) == text


@pytest.mark.parametrize("size, overlap", [(65_536, 1_024), (40, 6), (7, 1)])
def test_encode_and_decode(sql, odd, size, overlap):
    rnd = random.Random(3)
    more = [(100 + i, "".join(rnd.choices(SIGNS, k=rnd.randint(20, 400)))) for i in range(40)] + [(900, "x" * 500), (901, " " * 300), (902, "ab " * 200)]
    docs = odd.select("doc_id", "text").unionByName(sql.createDataFrame(more, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    found = bpe.encode(docs, RANKS, size=size, overlap=overlap)
    encoder = plain(RANKS)
    want = [(i, np.array(encoder.many([t])[0], dtype="<u4").tobytes()) for i, t in texts]
    assert B.by_text((r["doc_id"], bytes(r["ids"])) for r in found.collect()) == B.by_text(want)
    back = bpe.decode(found, RANKS, keep=("doc_id", "n_tokens"))
    got = B.by_text((r["doc_id"], r["n_tokens"], bytes(r["bytes"])) for r in back.collect())
    assert got == B.by_text((i, len(x) // 4, t.encode()) for (i, x), (_, t) in zip(want, texts, strict=True))


def test_no_rows(odd):
    none = odd.where("false")
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0
    assert packing.pack(none, JSON).count() == 0


def test_plan_holds_every_piece():
    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.choice([3, 7, 30, 100])
        counts = {n: rnd.randint(1, 50) for n in rnd.sample(range(1, capacity + 1), rnd.randint(1, min(capacity, 12)))}
        patterns = packing.plan(counts, capacity)
        held = {}
        for pattern, bins in patterns:
            assert sum(pattern) <= capacity and bins > 0
            assert sum(n > capacity // 3 for n in pattern) <= 2
            for n in pattern:
                held[n] = held.get(n, 0) + bins
        assert held == counts
        volume = -(-sum(n * k for n, k in counts.items()) // capacity)
        alone = sum(k for n, k in counts.items() if 2 * n > capacity)  # no two of these share a bin
        # of the pieces over a third, at best two share a bin
        pairs = -(-sum(k for n, k in counts.items() if 3 * n > capacity) // 2)
        assert sum(b for _, b in patterns) <= 1.5 * max(volume, alone, pairs) + 1
    assert sum(b for _, b in packing.plan({60: 10, 40: 10}, 100)) == 10
    assert sum(b for _, b in packing.plan({50: 4, 25: 8}, 100)) == 4


def fewest_bins(pieces, capacity):
    """The least number of bins, by trying every place for every piece."""
    best = len(pieces)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for k in {room: k for k, room in enumerate(bins) if room >= pieces[i]}.values():
            place(i + 1, [*bins[:k], bins[k] - pieces[i], *bins[k + 1 :]])
        place(i + 1, [*bins, capacity - pieces[i]])

    place(0, [])
    return best


def test_plan_is_near_the_optimum_of_small_cases():
    rnd = random.Random(6)
    cases = [([51] * 11, 100), ([17] * 8, 30)] + [(sorted((rnd.randint(1, c) for _ in range(rnd.randint(1, 8))), reverse=True), c) for c in (6, 10, 21) for _ in range(60)]
    more = 0
    for pieces, capacity in cases:
        counts = {n: pieces.count(n) for n in set(pieces)}
        used, least = sum(b for _, b in packing.plan(counts, capacity)), fewest_bins(pieces, capacity)
        assert least <= used <= least + 1
        more += used > least
    assert more <= len(cases) // 20


def test_pack(sql, odd):
    rnd = random.Random(5)
    more = [(100 + i, " ".join(rnd.choices(["alpha", "beta", "gamma", "x"], k=rnd.randint(1, 60)))) for i in range(60)]
    docs = odd.select("doc_id", "text").unionByName(sql.createDataFrame(more, "doc_id long, text string"))
    rows = packing.pack(docs, JSON, capacity=32, end_id=2, with_ids=True).collect()
    encoder = plain(JSON)
    want = []
    for r in docs.collect():
        ids = [*encoder.many([r["text"] or ""])[0], 2]
        cuts = [0, *range((len(ids) - 1) % 32 + 1 if len(ids) > 32 else len(ids), len(ids) + 1, 32)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert B.by_text((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == B.by_text(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 32
    assert len(bins) <= 1.1 * sum(w[3] for w in want) / 32 + 1
