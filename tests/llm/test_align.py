"""Alignment against token by token versions on the libraries' own ids."""

import hashlib
import random
from collections import Counter

import llm_brute as B
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from evalspark.llm import align

A, P = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "the", " of", "tion", "1", "²", "!", "漢", "　", "😀", "\0", "<s>", "<0x0A>", "▁", "\r\n", "<|endoftext|>"]


def spelled(text):
    """(ids, byte ends) of both sides of a text, or None."""
    t = Tokenizer.from_file(A) if not hasattr(spelled, "a") else spelled.a
    t.encode_special_tokens = True
    spelled.a = t
    m = sentencepiece.SentencePieceProcessor(model_file=P) if not hasattr(spelled, "b") else spelled.b
    spelled.b = m
    if not text:
        return None
    signs = align.byte_signs()
    ids = t.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(signs[c] for c in t.id_to_token(i))) for i in ids]
    b = [(i, bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()) for i in m.encode(text)]
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in (a, b)):
        return None
    return [([i for i, _ in s], np.cumsum([len(x) for _, x in s]).tolist()) for s in (a, b)]


def groups_of(text):
    found = spelled(text)
    if found is None:
        return []
    (ids_a, ends_a), (ids_b, ends_b) = found
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
        groups.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return groups


def plain(rows):
    every = [groups_of(t) for _, t in rows]
    count = Counter(p for g in every for p in {(x, y) for a, b in g for x in a for y in b})
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for (i, _), g in zip(rows, every, strict=True):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == highest[p[0]] for p in links),
            sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


def texts(n, seed=1, most=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(SIGNS, k=rnd.randint(1, most))) for _ in range(n)]


def test_pieces_equal_the_library():
    side = align.sides(A, P)[1]
    found = texts(3000, most=14) + ["x", " ", "  ", "\n", "a b", " a  b  ", B.thue_morse(1024), B.thue_morse(1024, "ba")]
    spaced = [" " + t for t in found]
    ids, bounds = side.encode(spaced)
    model = sentencepiece.SentencePieceProcessor(model_file=P)
    for i, t in enumerate(found):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == model.encode(t), repr(t)


def test_coalesce_breaks_where_all_end():
    assert align.coalesce(np.array([0, 2, 5, 0, 5, 6]), np.array([2, 5, 8, 5, 6, 8])).tolist() == [0, 0, 1, 0, 1, 1]
    assert align.coalesce(np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("block_bytes", [1, 4_000_000])
def test_align(sql, odd, monkeypatch, block_bytes):
    more = [(100 + i, t) for i, t in enumerate(texts(120) + ["the same text"] * 5 + ["x▁y", " " * 400, "ab" * 300, "\n" * 50])]
    docs = odd.select("doc_id", "text").unionByName(sql.createDataFrame(more, "doc_id long, text string")).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = align.align(docs, A, P, block_bytes=block_bytes)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert B.by_text(tuple(r) for r in found.collect()) == B.by_text(plain(rows))
    listed = align.groups(docs.where("doc_id >= 100"), A, P).collect()
    want = [(i, k, a, b) for i, t in rows if i is not None and i >= 100 for k, (a, b) in enumerate(groups_of(t))]
    assert B.by_text((r["doc_id"], r["nth"], r["a"], r["b"]) for r in listed) == B.by_text(want)
    by_id = dict(rows)
    for r in listed:
        assert r["start"] < r["end"] <= len((" " + by_id[r["doc_id"]]).encode())
    counts = {(r["a"], r["b"]): r["count"] for r in align.pair_counts(docs, A, P).collect()}
    assert counts == Counter(p for _, t in rows for p in {(x, y) for a, b in groups_of(t) for x in a for y in b})


def test_links_are_expanded_in_bounded_pieces(monkeypatch):
    side = align.sides(A, P)
    some = texts(30, seed=3)
    whole = [x.tolist() for x in align.Aligned(some, *side).pairs()]
    monkeypatch.setattr(align, "EXPAND", 7)
    assert [x.tolist() for x in align.Aligned(some, *side).pairs()] == whole


def test_columns_clash_and_no_rows(sql, odd):
    clash = odd.withColumnsRenamed({"lang": "block", "n_chars": "at", "n": "pairs"})
    assert align.align(clash, A, P).count() == odd.count()
    assert align.align(odd.where("false"), A, P).count() == 0
    assert align.groups(odd.where("false"), A, P).count() == 0
    named = align.align(odd.selectExpr("lang as name", "text as body"), A, P, id_col="name", text_col="body")
    assert named.columns[0] == "name" and named.count() == odd.count()


def test_long_texts(sql):
    rnd = random.Random(9)
    words = [w for t in texts(200, seed=5) for w in t.split()]
    long = " ".join(rnd.choices(words, k=150_000)).replace("▁", "_")
    docs = sql.createDataFrame([(1, long), (2, "the end"), (3, "x" * 200_000), (4, " " * 200_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in align.align(docs, A, P).collect()}
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    assert found[1]["n_a"] == len(t.encode(" " + long, add_special_tokens=False).ids) and found[1]["n_groups"] > 100_000
    assert found[4]["n_groups"] >= 1 and found[4]["n_links"] >= found[4]["n_a"]
