import random

import llm_brute as B
import pytest
from pyspark.sql import functions as F

from evalspark.llm import near, repeats, templates
from evalspark.llm.components import components
from evalspark.llm.words import Words, slices


def changed_copies(rnd, n, sizes, vocabulary):
    v = [f"w{i}" for i in range(vocabulary)]
    base = [rnd.choices(v, k=rnd.choice(sizes)) for _ in range(n // 25)]
    docs = []
    for i in range(n):
        x = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            x[rnd.randrange(len(x))] = rnd.choice(v)
        docs.append((i, " ".join(x)))
    return docs


def test_components(sql):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + chain + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(sql.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}
    assert components(sql.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("words, num, den", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_links_equal_brute_force(sql, words, num, den):
    docs = changed_copies(random.Random(words), 400, [3, 5, 8, 12, 20, 40, 70, 120], 400)
    got = near.link(sql.createDataFrame(docs, "doc_id long, text string").repartition(4), words, (num, den))
    assert B.by_text(tuple(r) for r in got.collect()) == B.by_text(B.linked(docs, words, num, den))


def test_groups_whose_members_are_barely_linked(sql, monkeypatch):
    """Copies of one text with changes of their own: about half of all pairs are linked, and rounds of further centres run."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(70)]
    docs = []
    for i in range(240):
        x = list(base)
        for at in rnd.sample(range(70), rnd.choice([0, 1, 1, 2, 2, 3])):
            x[at] = f"n{i}x{at}"
        docs.append((i, " ".join(x)))
    met = []
    plain = near._with_centres
    monkeypatch.setattr(near, "_with_centres", lambda *a: met.append(a[2]) or plain(*a))
    got = B.by_text(tuple(r) for r in near.link(sql.createDataFrame(docs, "doc_id long, text string").repartition(4), 4, (85, 100)).collect())
    assert got == B.by_text(B.linked(docs, 4, 85, 100))
    assert met


def test_links_of_odd_rows(odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = B.by_text(tuple(r) for r in near.link(odd, 4, (85, 100)).collect())
    assert got == B.by_text(B.linked(docs, 4, 85, 100))
    assert near.link(odd.where("false")).count() == 0


def test_parts_agree_for_linked_sets():
    """Sets within the bound share a key, also at the edges of size classes."""
    import numpy as np

    rnd = np.random.default_rng(3)
    rule = near.Rule(4, 85, 100)

    def orders(a, b):
        """Nothing known to be frequent; some common parts; all common parts, which is the worst order."""
        keys = [np.concatenate([k for k, _, _ in near.parts(x, rule)] or [np.zeros(0, np.int64)]) for x in (a, b)]
        common = np.intersect1d(*keys)
        for some in (common[:0], common[::2], common):
            yield near.Frequent(some.tolist(), rnd.integers(2, 9, len(some)).tolist())

    for size in [6, 7, 8, 9, 11, 12, 13, 16, 17, 25, 60, 200, 1000]:
        for _ in range(20):
            a = np.unique(rnd.integers(0, 2**64, size, dtype=np.uint64))
            most = rule.differing(size)
            drop = int(rnd.integers(0, most + 1))
            b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2**64, most - drop, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 85 * (len(a) + len(b) - common):
                assert all(set(near.handed_out(a, rule, order)) & set(near.handed_out(b, rule, order)) for order in orders(a, b))
                bits = sum(int(x).bit_count() for x in (near.sketch(a) ^ near.sketch(b)).view(np.uint64))
                assert bits <= len(a) + len(b) - 2 * common


@pytest.mark.parametrize("window, gram", [(12, 4), (12, 12), (5, 1)])
def test_repeats_equal_brute_force(sql, window, gram):
    rnd = random.Random(window + gram)
    v = [f"w{i}" for i in range(30)]
    passages = [rnd.choices(v, k=40) for _ in range(6)]
    docs = []
    for i in range(200):
        x = rnd.choices(v, k=rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 2)):
            a = rnd.randint(0, 20)
            x += rnd.choice(passages)[a : a + rnd.randint(5, 40)] + rnd.choices(v, k=rnd.randint(0, 4))
        docs.append((i // 2 * 2 if i % 17 == 0 else i, "  ".join(x)))
    docs += [(None, docs[3][1]), (None, None), (7, ""), (8, "a " * 20), (9, "a " * 20), (500, docs[0][1])]
    df = sql.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in repeats.remove_repeats(df, window, gram).collect()]
    assert B.by_text(got) == B.by_text(B.without_repeats(docs, window))


def test_repeats_keep_columns_and_layout(sql, odd):
    text = "\n".join(f"line {i} of this text" for i in range(6))
    rows = sql.createDataFrame([(1, text, "en"), (2, f"own start\n\n{text}\n  own end", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(rows, 20, 4, keep=["lang"], joiner=None).collect()}
    assert got[1]["text"] == text and got[1]["spans"] == []
    assert got[2]["text"] == "own start\n\nown end" and got[2]["lang"] == "de"
    assert [(s["first"], s["end"]) for s in got[2]["spans"]] == [(2, 32)]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in repeats.remove_repeats(odd, keep=["lang", "k0"]).collect()]
    assert B.by_text(got) == B.by_text(B.without_repeats(docs, 50))
    assert repeats.remove_repeats(odd.where("false")).count() == 0


def test_recurring_lines(sql):
    rnd = random.Random(6)
    v = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    prose = lambda: " ".join(rnd.choices(v, k=12))
    docs = []
    for i in range(60):
        lines = [prose() for _ in range(5)]
        if i % 2:
            lines.insert(rnd.randint(0, 5), f"Posted by {rnd.choice(['ann', 'bob', 'cem', 'dan'])} on 2024-01-{i:02d} at noon")
        if i % 3 == 0:
            lines.append("All rights reserved here.")
        lines += ["Ok."]
        docs.append((i, "\n".join(lines)))
    copied = "\n".join(prose() for _ in range(5))
    docs += [(100 + i, copied) for i in range(30)]
    got = {r["doc_id"]: r for r in templates.drop_recurring(sql.createDataFrame(docs, "doc_id long, text string").repartition(3), depth=2, similar=0.6).collect()}
    for i, text in docs:
        left = [x for x in text.split("\n") if not x.startswith(("Posted by", "All rights"))]
        assert got[i]["text"] == "\n".join(left), i
        assert got[i]["n_lines"] == len(text.split("\n")) and got[i]["n_dropped"] == len(text.split("\n")) - len(left)


def test_recurring_lines_of_odd_rows(odd):
    got = templates.drop_recurring(odd, min_docs=2, keep=["lang", "score"])
    assert got.columns == ["doc_id", "lang", "score", "n_lines", "n_dropped", "text"]
    assert B.by_text((r["doc_id"], r["text"]) for r in got.collect()) == B.by_text((r["doc_id"], r["text"]) for r in odd.collect())
    assert templates.drop_recurring(odd.where("false")).count() == 0


def test_words_are_the_pattern(sql):
    import pyarrow as pa

    texts = ["", None, "a\x0bb", " é  你好 x y\t\x1c\x85", "\n\n", "x"]
    for _, _, data, offsets in slices(pa.array(texts), 4):
        w = Words(data, offsets)
        for i in range(len(offsets) - 1):
            own = [bytes(data[a:b]).decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)]
            assert own == B.words(w.text_of(i).decode())


def test_copies_in_many_rows(sql):
    """A text in most of the rows is one class, and only its first document keeps it."""
    text = " ".join(f"t{i}" for i in range(60))
    docs = sql.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, text).otherwise(F.concat(F.lit("z "), F.col("id"))).alias("text")).repartition(8)
    found = near.link(docs).where("doc_id % 3 < 2")
    assert {r["component_id"] for r in found.collect()} == {0}
    assert repeats.remove_repeats(docs).where("n_removed = n_words").count() == 199


def _letters(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:04d}")


def _bodies(rnd, n, lines=3, length=8):
    """Lines that share neither a word with another document."""
    return ["\n".join(" ".join(f"q{_letters(rnd.randrange(10000))}{_letters(i)}" for _ in range(length)) for _ in range(lines)) for i in range(n)]


def test_header_and_footer_of_the_same_documents(sql):
    """Whatever the hashes of the words, lines that stand in the same distinct documents go together."""
    rnd = random.Random(11)
    kept = []
    for draw in range(6):
        mark = _letters(rnd.randrange(10000))
        docs = [(i, f"Start {mark} of every page here\n{b}\n" + " ".join(f"foot{mark}{_letters(k)}" for k in range(14))) for i, b in enumerate(_bodies(rnd, 15, 1, 22))]
        got = templates.drop_recurring(sql.createDataFrame(docs, "doc_id long, text string").repartition(2))
        kept += [(draw, r["doc_id"]) for r in got.collect() if r["n_dropped"] != 2]
    assert kept == []


def test_copies_neither_hide_nor_make_recurring_lines(sql):
    rnd = random.Random(12)
    line = "This line stands in distinct pages"
    bodies = _bodies(rnd, 40)
    docs = [f"{line}\n{b}" for b in bodies[:20]] + [f"{line}\n{bodies[20]}"] * 60  # more copies than distinct documents
    docs += [f"Twelve texts with many copies hold this\n{b}" for b in bodies[21:33] for _ in range(12)]
    changed = []
    for _ in range(120):  # copies of one text with a word changed, also at the ends of lines
        words = [x.split(" ") for x in bodies[33].split("\n")]
        words[rnd.randrange(3)][rnd.randrange(8)] = f"new{_letters(rnd.randrange(10000))}"
        changed.append("\n".join(" ".join(x) for x in words))
    df = sql.createDataFrame(list(enumerate(docs + changed)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in templates.drop_recurring(df).collect()}
    want = ["\n".join(t.split("\n")[1:]) for t in docs] + changed
    assert [got[i] for i in range(len(want))] == want


def test_lines_below_similar_are_their_own_template(sql):
    """At production parameters; digits are masked, lines of digits only are not."""
    rnd = random.Random(13)
    docs = []
    for i, b in enumerate(_bodies(rnd, 24)):
        lines = ["(c) 2024 Acme", f"Page {i} of 34", f"Posted {i + 1} March 2021 at 10:{i + 10}", "12 of", f"{i} {i * 7} {i * 9}", "2024 10 12"]
        docs.append((i, "\n".join([*lines[:3], b, *lines[3:]])))
    got = {r["doc_id"]: r["text"] for r in templates.drop_recurring(sql.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()}
    assert got == {i: "\n".join([*t.split("\n")[3:6], "12 of", f"{i} {i * 7} {i * 9}"]) for i, t in docs}


def test_recurring_lines_equal_brute_force(sql, tmp_path):
    """The registered query at its own parameters, with lines of one and two words."""
    from evalspark.llm import queries

    rnd = random.Random(14)
    bodies = _bodies(rnd, 60, 4, 9)
    docs = []
    for i, b in enumerate(bodies[:50]):
        lines = b.split("\n")
        lines += [x for x, n in (("Read more", 30), ("Advertisement", 25), ("Sign in", 10), ("Nine only", 9), ("Ten pages hold this line", 10), ("7", 12)) if i < n]
        lines += [f"Posted by {rnd.choice(['ann', 'bob', 'cem', 'dan'])} on day {i} of March at noon", "(c) 2024 Acme", "", " \t", f"{i} {i}"]
        rnd.shuffle(lines)
        docs.append((i, "\n".join(lines) + "\r\n" * (i % 3)))
    docs += [(100 + i, f"Read more\nOnly copies hold this line\nShort\n{bodies[50]}") for i in range(40)]
    docs += [(200 + 20 * k + i, f"Of many copied texts\n{bodies[51 + k % 6]}\nThird {_letters(k % 6)}") for k in range(6) for i in range(12)]
    for i in range(60):
        words = bodies[58].replace("\n", " \n ").split(" ")
        words[rnd.choice([p for p, w in enumerate(words) if w != "\n"])] = f"new{_letters(i)}"
        docs.append((500 + i, " ".join(words).replace(" \n ", "\n") + "\nRead more"))
    docs += [(None, None), (None, docs[3][1]), (None, docs[3][1]), (5, docs[5][1]), (600, ""), (601, "\n"), (602, "Read more"), (603, "Read more\n")]
    sql.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in queries.op8_line_dedup(sql, str(tmp_path)).collect()]
    want = B.without_recurring(docs)
    assert B.by_text(got) == B.by_text(want)
    left = {x.strip() for _, _, _, t in want for x in (t or "").split("\n")}
    assert not left & {"Read more", "Advertisement", "Sign in", "Ten pages hold this line", "(c) 2024 Acme", "7"}
    assert left >= {"Nine only", "Only copies hold this line", "Short", "Of many copied texts", *bodies[50].split("\n")}


def test_texts_with_dropped_lines_are_parsed_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["Keep it here\nGo away now", "\n\n", "", "Go away now\nKeep it here\n", "Go away now", "Keep 1 é\nGo away now\n\nGo away now"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    one = templates.Lines(np.frombuffer(b"Go away now", dtype=np.uint8), np.array([0, 11]), 3, 3).body.tolist()
    made = []
    parse = templates.Lines
    monkeypatch.setattr(templates, "Lines", lambda *args: made.append(1) or parse(*args))
    gone = pa.array([one, None, one, one, one, [*one, 5]], pa.list_(pa.int64()))
    n, dropped, left, at = templates._without(data, offsets, gone, 3, 3)
    found = [left[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == ["Keep it here", "\n\n", "", "Keep it here\n", "", "Keep 1 é\n"]
    assert n.tolist() == [2, 0, 0, 2, 1, 3] and dropped.tolist() == [1, 0, 0, 1, 1, 2]
    assert len(made) == 1


def test_sets_of_a_slice_are_named_and_compared_together():
    import numpy as np
    import zlib

    rule = near.Rule(4, 85, 100)
    raw = [b"One two three four five", b"", b"six", b"one two three four five", b"a b c d e a b c d e"]
    together = near._sets_of(raw, rule)
    alone = [near._sets_of([r], rule)[0] for r in raw]
    assert [x.tolist() for x in together] == [x.tolist() for x in alone]
    assert [len(x) for x in together] == [2, 0, 1, 2, 5]
    names = near.identities(together)
    assert names == [near.identities([x])[0] for x in alone]
    assert names[0] == names[3] and len(set(names)) == 4
    assert near.identities([]) == [] and near.identities([np.zeros(0, np.uint64)]) == [names[1]]
    packed = [zlib.compress(r, 1) for r in raw]
    blocks = list(near._blocks([1, 1, 2, 2, 3], [4, 5, 6, 7, 8], packed, packed))
    assert [(a, b, y) for a, b, _, y in blocks] == [([1, 1, 2, 2, 3], [4, 5, 6, 7, 8], raw)]
    assert list(near._blocks([], [], [], [])) == []


def test_only_texts_that_share_a_part_are_written(sql, monkeypatch):
    rnd = random.Random(9)
    docs = [(i, " ".join(f"u{i}x{k}" for k in range(60))) for i in range(40)]
    copy = docs[7][1].split()
    copy[30] = "other"
    docs += [(40, " ".join(copy)), (41, docs[3][1])]
    rnd.shuffle(docs)
    rows = {}

    def kept(df, name, write=near.written):
        out = write(df, name)
        if "body" in df.columns:
            rows[name] = out.count()
        return out

    monkeypatch.setattr(near, "written", kept)
    got = near.link(sql.createDataFrame(docs, "doc_id long, text string").repartition(3), 5, (80, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: {40: 7, 41: 3}.get(i, i) for i in range(42)}
    assert rows and max(rows.values()) <= 4  # equal sets share no part with another set
