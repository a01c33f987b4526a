"""Hashes and encoders on texts on which polynomial hashes modulo a power of two collide."""

import llm_brute as B
import numpy as np
import public_tokenizers
import pytest

from evalspark.llm import bpe, near, repeats, templates, tokens, words
from evalspark.llm.words import Words, spans_hash

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
SIZES = [1024, 2048, 4096]


def both(n):
    return B.thue_morse(n), B.thue_morse(n, "ba")


def words_of(texts):
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))


def test_runs_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 40, dtype=np.uint64)
    line = np.concatenate([rng.integers(0, 2**64, 3000, dtype=np.uint64), values, rng.integers(0, 2**64, 500, dtype=np.uint64), values])
    at = np.array([3000, 3540, 0, 1])
    found = spans_hash(line, at, at + 40)
    assert found[0] == found[1] and len(set(found.tolist())) == 3
    assert len(set(spans_hash(line, at[:2], at[:2] + np.array([40, 39])).tolist())) == 2
    assert len(spans_hash(line, at[:0], at[:0])) == 0


@pytest.mark.parametrize("n", SIZES)
def test_words_and_runs_differ(n):
    one, two = both(n)
    w = words_of([one, two, " ".join(one), " ".join(two)])
    assert w.hashes[0] != w.hashes[1]
    runs = w.runs(w.first[2:4], w.counts[2:4])
    assert runs[0] != runs[1]
    for x in (one, two):
        assert len(set(words_of([x[:k] for k in range(1, 65)]).hashes.tolist())) == 64


@pytest.mark.parametrize("path", [RANKS, JSON])
def test_encoders_equal_the_library(path):
    texts = [x for n in SIZES for x in both(n)] + [" ".join(both(2048))]
    encoder = tokens.tiktoken_encoder(path)[0] if path == RANKS else tokens.tokenizers_encoder(path)
    ids, bounds = encoder.ids(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.many([text])[0]


def test_pieces_that_share_a_hash_go_to_the_library(monkeypatch):
    """Whatever the hash, pre-tokens are compared themselves."""
    monkeypatch.setattr(tokens, "spans_hash", lambda values, starts, ends: (ends - starts).astype(np.uint64))
    encoder = tokens.Encoder(tokens.tiktoken_encoder(RANKS)[0].many)
    texts = ["abc def", "xyz, 123", "", "abc def ghi"]
    for _ in range(2):
        ids, bounds = encoder.ids(texts)
        for i, text in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.many([text])[0]


def test_operators_tell_them_apart(sql):
    rows = [(k, x) for k, x in enumerate([x for n in SIZES for x in both(n)] + [x for n in (1024, 2048) for x in map(" ".join, both(n))])]
    docs = sql.createDataFrame(rows, "doc_id long, text string")
    found = near.link(docs, words=4, similarity=(85, 100)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == B.linked(rows, 4, 85, 100)
    decoded = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in decoded} == dict(rows)
    kept = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs.where("doc_id < 6"), window=50).collect()}
    assert kept == {k: x for k, x in rows if k < 6}
    few = sql.createDataFrame([(k, f"{both(2048)[k % 2] if k < 2 else 'other'} {k}\nown{k} line") for k in range(8)], "doc_id long, text string")
    lines = templates.drop_recurring(few, min_tokens=1, min_docs=2).where("doc_id < 2").collect()
    assert all("a" in r["text"] for r in lines)


def test_inverse_powers_of_a_slice_are_made_once(monkeypatch):
    values = np.arange(1, 5_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(0, 4_000, 7)
    first = words.spans_hash(values, at, at + 9)
    monkeypatch.setattr(words, "_accumulate", None)  # not needed again
    assert (words.spans_hash(values, at, at + 9) == first).all()
    assert words.spans_hash(values[7:], at[:-1], at[:-1] + 9).tolist() == first[1:].tolist()


def test_powers_beyond_the_table_agree_with_it():
    at = np.array([0, 1, 1023, 1024, 1_099_999])
    for k in range(2):
        near, far = words._backward(k, at), words._backward(k, np.append(at, 1_200_000))
        assert near.tolist() == far[:-1].tolist()
