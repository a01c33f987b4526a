import gzip
import io
import random
import struct
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import mainpage, quality, queries, vafile, wacz, weak


def oracle(name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        con.register(table, df.toPandas().convert_dtypes() if table != "embeddings" else df.toArrow())
    return sorted((tuple(r) for r in con.sql(queries.ORACLES[name]).fetchall()), key=str)


def test_quality_rules_against_sql(sql, odd):
    rnd = random.Random(1)
    v = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    docs = [(i, " ".join(rnd.choices(v, k=rnd.randint(1, 200)))) for i in range(120)]
    docs = [(i, t.replace(" ", " # %$ ") if i % 7 == 0 else t.upper().replace(" ", "!! ") if i % 11 == 0 else t + "\nsame\nsame") for i, t in docs]
    df = sql.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("doc_id != 5 and text is not null"))
    got = weak.judge(df.repartition(3)).drop("votes", "posterior")
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    want = con.sql(queries.ORACLES["op1_quality_rules"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    assert all(not kept[i] for i, _ in docs if i % 7 == 0)


def test_quality_rules_of_odd_rows(odd):
    got = weak.judge(odd).collect()
    assert len(got) == odd.count()
    assert {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert weak.judge(odd.where("false")).count() == 0


def test_repeated_windows(sql):
    df = sql.createDataFrame([(1, "a b c a b c a"), (2, "x " * 60), (3, "a b a b"), (4, "a b a b a")], "doc_id long, text string")
    assert {r["id"]: r["n_repeat_words"] for r in weak.measures(df).collect()} == {1: 7, 2: 60, 3: 0, 4: 5}


def test_classifier_learns_and_keeps_labels_out(sql, odd):
    rnd = random.Random(2)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}!" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(good if i % 3 else bad, k=rnd.randint(20, 60))), int(i % 3 > 0)) for i in range(400)]
    docs = sql.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = docs.select("doc_id", "quality", F.lit(0).alias("toxic"))
    model = quality.train(docs.drop("quality"), labels.where(~quality.held_out()))
    found = quality.score(docs, model, ["doc_id", "quality"]).withColumn("held_out", quality.held_out()).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in found if r["held_out"]]) > 0.97
    again = quality.score(docs.repartition(7), model, ["doc_id"]).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in found}  # whatever the batches
    odd_scores = quality.score(odd, model, ["doc_id", "score", "lang"], name="chance").collect()
    assert len(odd_scores) == odd.count() and all(0 <= r["chance"] <= 1 for r in odd_scores)
    assert len({r["chance"] for r in odd_scores if r["doc_id"] in (1, 2, 3)}) == 1


def test_classifier_without_labels(sql, odd):
    labels = sql.createDataFrame([(1, None), (4, 0), (4, 1), (None, 1), (6, 7)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    assert {r["s"] for r in quality.score(odd, model, ["doc_id"], name="s").collect()} == {0.5}
    assert quality.score(odd.where("false"), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("scale, outlier", [(1, 0), (1, 10**6), (2**40, 0), (10**12 * 2**40, 0)])
def test_best_equals_full_scan(scale, outlier):
    rng = np.random.default_rng(scale % 97)
    v = rng.integers(-3, 4, (300, 5)) * (scale if scale < 2**62 else 2**61)
    if outlier:
        v[5, 2] = outlier
    ids = np.arange(300)
    found = vafile.best(ids, v, ids[::7], v[::7], 20)
    for i in ids[::7]:
        every = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(v[i], v[j], strict=True)), -(2**63)), 2**63 - 1), int(j)) for j in ids if j != i)
        assert sorted((-s, c) for q, c, s in found if q == i) == every[:20]


def test_search_of_odd_rows(sql):
    rows = [
        (0, [1.0, 2.0]), (20, [1.0]), (20, [0.5]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [0.3, -0.4]), (4, [0.3, -0.4]),
        (None, [1.0, 1.0]), (40, []), (41, []), (5, [float("inf"), 0.0]),
    ]
    df = sql.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(r) for r in vafile.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 4, -2112), (40, 1, 41, 0)]
    assert vafile.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_search_in_small_blocks(sql):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    df = sql.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(tuple(r) for r in vafile.search(df, F.col("vec_id") % 20 == 0).collect())
    small = sorted(tuple(r) for r in vafile.search(df, F.col("vec_id") % 20 == 0, block=16, group=3).collect())
    assert whole == small and len(whole) == 200
    assert [tuple(r) for r in oracle("op6_exact_topk", embeddings=df)] == sorted(whole, key=str)


def zip64(name, data):
    """A ZIP file whose central directory and end record use the ZIP64 forms only."""
    local = struct.pack("<IHHHHHIIIHH", wacz.LOCAL, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20)
    local += name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    entry = struct.pack("<IHHHHHHIIIHHHHHII", wacz.ENTRY, 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF)
    entry += name + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    at = len(local) + len(data)
    end64 = struct.pack("<IQHHIIQQQQ", wacz.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<IIQI", wacz.LOCATOR64, 0, at + len(entry), 1)
    end = struct.pack("<IHHHHIIH", wacz.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return local + data + entry + end64 + locator + end


def test_members_by_directory():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"12345")
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 with a signature"
    data = out.getvalue()
    first, second = wacz.members(io.BytesIO(data), len(data))
    assert data[first.offset : first.offset + first.size] == b"12345" and first.method == 0
    assert (second.name, second.method) == ("packed", 8)
    large = zip64(b"archive/b.warc.gz", b"abcdef")
    (only,) = wacz.members(io.BytesIO(large), len(large))
    assert large[only.offset : only.offset + only.size] == b"abcdef"
    for broken in (b"", b"PK", data[:-30], b"x" * 100):
        with pytest.raises(ValueError):
            wacz.members(io.BytesIO(broken), len(broken))


def test_archives_round_trip(sql):
    rows = [
        (1, "http://a", "x" * 1500), (2, None, "x" * 1500), (2, "u\r\nv", "x" * 1500), (None, "http://a", "x" * 1500), (3, "b", None),
        (4, "b", "é" * 400), (5, "b", "é" * 400), (6, "c", "é\r\n\r\n" * 600), (7, "c", "é\r\n\r\n" * 600), (8, "", ""),
    ]
    pages = sql.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(2)
    archives = wacz.write_archives(pages, archive_bytes=300)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    found = wacz.read_records(archives, range_bytes=500).collect()
    key = lambda r: (r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"], bytes(r["payload"]) if r["payload"] is not None else None)
    large, other = "x" * 1500, "é\r\n\r\n" * 600
    want = [
        ("<urn:page:1>", "revisit", "<urn:page:2>", 1500, None), ("<urn:page:>", "revisit", "<urn:page:2>", 1500, None),
        ("<urn:page:6>", "revisit", "<urn:page:7>", len(other.encode()), None),
    ] + [(f"<urn:page:{i}>", "response", None, len(t.encode()), t.encode()) for i, t in [(2, large), (2, large), (3, ""), (4, "é" * 400), (5, "é" * 400), (7, other), (8, "")]]
    assert sorted(map(key, found), key=str) == sorted(want, key=str)
    assert wacz.read_records(wacz.write_archives(pages.where("false"))).count() == 0


def test_archive_without_index(sql, tmp_path):
    record = gzip.compress(wacz.record(1, "u", b"abc", "00" * 20, None, False)) + gzip.compress(wacz.record(2, "u", b"d", "00" * 20, None, False))
    with zipfile.ZipFile(tmp_path / "x.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", record)
    paths = sql.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")
    assert sorted(bytes(r["payload"]) for r in wacz.read_records(paths).collect()) == [b"abc", b"d"]


@pytest.fixture(scope="module")
def chain():
    page = "<html><body><nav><ul><li><a href=x>menu</a></li></ul></nav><article><h1>Title {0}</h1><p>A paragraph of some words {0}.</p><p>More of it.</p><p>And a third one, {0}.</p><p>Last of all.</p></article><div class=ad>Buy {0}!</div><footer>&copy; {0}</footer>"
    model = mainpage.Chain()
    examples = mainpage.labelled([(i, page.format(i)) for i in range(60)], 8)
    random.Random(1).shuffle(examples)
    model.learn(examples, 8)
    return model


def test_main_text_of_other_layouts(chain):
    page = """<html><body><div class="cookie-banner"><p>We use cookies.</p></div><header><h2>Site name</h2></header><div id="content"><h1>Real title</h1>
    <p>First   paragraph,&nbsp;long &amp; good.<p>Second <a href=x>link</a><br>para.<script>var a = "<p>no</p>"</script></p><div class="advertisement">Buy now.</div><p>Third.</p></div>
    <div id="comments"><h3>Comments</h3><p>Great article, thanks.</p></div><form><label>Name</label><button>Send</button></form><aside><p>Related.</p></aside><footer>&copy; 2020</footer>"""
    assert mainpage.main_text(page, chain) == "Real title First paragraph, long & good. Second link para. Third."
    for empty in (None, "", "<html></html>", "<p", "<!-- x", "<script>var x"):
        assert mainpage.main_text(empty, chain) == ""


def test_held_out_layouts(chain):
    page = "<article><h1>About {0}</h1><p>Words {0} and more.</p><p>The end of {0}, at last.</p></article><footer>Foot {0}</footer><nav><li>Go {0}</li></nav>"
    wrong = total = 0
    for blocks, labels in mainpage.labelled([(1000 + i, page.format(i)) for i in range(40)], 6):
        wrong += sum(a != b for a, b in zip(chain.decode(blocks), labels, strict=True))
        total += len(labels)
    assert wrong < 0.03 * total


def test_viterbi_is_the_best_path(chain):
    import itertools

    page = mainpage.labelled([(5, "<article><p>a b c.</p></article>")], 3)[2][0][:9]
    s = chain.scores(page)

    def value(labels):
        return sum(x * y for x, y in zip(s, labels, strict=True)) + sum(chain.pairs[a][b] for a, b in zip(labels[:-1], labels[1:], strict=True))

    best = max(itertools.product((0, 1), repeat=len(page)), key=value)
    assert value(chain.decode(page)) == pytest.approx(value(best))


def test_extract_rows(sql):
    rows = [(1, "u", "<article><p>Main text here.</p></article><footer>Foot</footer>"), (None, None, None), (2, "", ""), (2, "", "")]
    pages = sql.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    model = mainpage.train(pages, sample=5)
    got = sorted((tuple(r) for r in mainpage.extract(pages, model, ["page_id", "url"]).collect()), key=str)
    assert got == sorted([(1, "u", "Main text here.", 15), (None, None, "", 0), (2, "", "", 0), (2, "", "", 0)], key=str)
    assert mainpage.extract(pages.where("false"), mainpage.train(pages.where("false")), ["page_id"]).count() == 0
