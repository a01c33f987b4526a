import random

import llm_brute as B
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from evalspark.llm import quality
from evalspark.llm.tokens import tokenizers_encoder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(sql, tmp_path_factory):
    """Clean prose, junk, near copies, a shared passage and a recurring line."""
    rnd = random.Random(8)
    v = [a + b for a in "ba ce di fo gu la me ni".split() for b in "ron tal sim ver kol pex".split()]
    prose = lambda n: " ".join(rnd.choices(v, k=n))
    passage = prose(70)
    docs, labels = [], []
    for i in range(160):
        lines = [prose(rnd.randint(20, 40)) for _ in range(3)]
        if i % 4 == 0:
            lines.insert(rnd.randint(0, 3), "Licensed to all readers for ever.")
        if i % 9 == 0:
            lines.append(f"{prose(3)} {passage} {prose(3)}")
        text = "\n".join(lines)
        if i % 5 == 1:
            text = " ".join(w + "%%%" for w in text.split())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 5 != 1), 0))
    for i in range(160, 190):  # near copies of a clean document
        text = docs[2][1].split(" ")
        text[rnd.randrange(len(text) - 10)] = "changed"
        docs.append((i, " ".join(text), "en", "s", 7))
    docs += [(190, None, None, None, None), (191, "", "en", "s", 0), (192, docs[2][1], "en", "s", 9)]
    where = tmp_path_factory.mktemp("tables")
    sql.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{where}/documents.parquet")
    sql.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages_against_plain_versions(sql, folder):
    docs = sql.read.parquet(f"{folder}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    after = []
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(sql, docs, folder), name)
        assert docs.columns == COLUMNS
        after.append({r["doc_id"]: r for r in docs.collect()})
    scored, lines, distinct, kept = after

    model = quality.train(sql.read.parquet(f"{folder}/documents.parquet"), sql.read.parquet(f"{folder}/labels.parquet").where(~quality.held_out()))
    want = {r["doc_id"] for r in quality.score(sql.read.parquet(f"{folder}/documents.parquet"), model, ["doc_id"]).collect() if r["score"] >= 0.5}
    assert set(scored) == want and want >= {i for i in before if i < 190 and (i >= 160 or i % 5 != 1)}
    assert not want & {i for i in range(160) if i % 5 == 1}

    assert set(lines) == set(scored)
    for i, r in lines.items():
        text = scored[i]["text"]
        left = text if text is None else "\n".join(x for x in text.split("\n") if not x.startswith("Licensed"))
        if i % 9 and i < 160:
            assert r["text"] == left, i
            assert r["n_chars"] == (before[i]["n_chars"] if left == text else len(left))

    links = B.linked([(i, r["text"]) for i, r in lines.items()], 5, 80, 100)
    assert set(distinct) == {i for i, _, root in links if i == root}
    assert 2 in distinct and not set(distinct) & {*range(160, 190), 192}

    plain = {i: (n, gone, left) for i, n, gone, left in B.without_repeats([(i, r["text"]) for i, r in distinct.items()], 50)}
    assert set(kept) == {i for i, (n, gone, _) in plain.items() if not n or gone < n}
    assert all(" ".join(B.words(kept[i]["text"])) == plain[i][2] for i in kept)
    assert sum(gone > 0 for _, gone, _ in plain.values()) >= 5


def test_run_packs_what_the_stages_keep(sql, folder):
    docs = sql.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(sql, docs, folder), name)
    rows = C.run(sql, folder).collect()
    encoder = tokenizers_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(encoder.many([r["text"] or ""])[0]) + 1 for r in docs.collect()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024
    assert len(ends) <= np.ceil(sum(want.values()) / 1024) * 1.2 + 1


def test_entry_lists_every_operator():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 14)}
    assert set(entry.oracle_sql()) >= {"op1_quality_rules", "op2_warc", "op6_exact_topk", "op12_chat_formatting"}


def test_no_rows(sql, folder):
    none = sql.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        assert stage(sql, none, folder).count() == 0
