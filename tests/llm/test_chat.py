"""Chat formatting: layouts by fingerprint, an exact round trip, and digests against a plain version."""

import hashlib
import json
import random

import llm_brute as B
import pytest

from evalspark.llm import chat

SIGNS = ["<turn>", "</turn>", "\\", "<", "/turn>", "\n", "a", " ", "é", "😀", "<\\/turn>", "\\\\n", "assistant", "<turn", "</turn>\n<turn>assistant\n"]


def some(n, seed=1):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choices(SIGNS, k=rnd.randint(0, 9)))
    return [(rnd.randint(0, n // 4), k, rnd.choice(["user", "assistant", "system", "a\nb", "x\\", "</turn>"]), text()) for k in range(n)]


def plain(rows):
    found = {}
    for i, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(i, []).append((role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for i, turns in found.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        out.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)))
    return out


@pytest.mark.parametrize("part_chars", [1, 60, 1_000_000])
def test_round_trip(sql, part_chars):
    rows = some(400) + [(None, 1, "user", "null id"), (None, 0, None, None), (5000, None, "assistant", "x"), (5000, 3, "assistant", None), (5000, 3, "assistant", None)]
    df = sql.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, loss int").repartition(5)
    parts = chat.render(chat.canonical(df, "conv_id"), "conv_id", part_chars=part_chars)
    found = chat.digest(parts, "conv_id")
    assert found.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kept = [tuple(r) for r in found.collect()]
    assert B.by_text(r[:5] for r in kept) == B.by_text(plain(rows))
    written = parts.collect()
    for r in written:
        assert part_chars > 1 or r["text"].count("<turn>") == 1
        assert r["text"].count("</turn>") == r["text"].count("<turn>")  # none stands in a text or role
    assert sum(r[5] for r in kept) == sum(len(r["text"]) for r in written)
    back = chat.read_turns(parts, "conv_id").collect()
    assert B.by_text((r["conv_id"], r["role"], r["text"]) for r in back) == B.by_text((i, role or "", text or "") for i, _, role, text in rows)
    assert all(r["trained"] == (r["role"] == "assistant") for r in back if r["text"])
    again = chat.digest(chat.in_order(parts.repartition(7), "conv_id"), "conv_id")
    assert B.by_text(tuple(r) for r in again.collect()) == B.by_text(kept)


def test_parts_out_of_order_are_refused(sql):
    parts = sql.createDataFrame([(1, 1, "", [])], "conv_id long, part long, text string, loss array<struct<start: long, end: long>>")
    with pytest.raises(Exception, match="not in order"):
        chat.digest(parts, "conv_id").collect()
    broken = sql.createDataFrame([(1, 0, "<turn>user", [])], "conv_id long, part long, text string, loss array<struct<start: long, end: long>>")
    with pytest.raises(Exception, match="no turn begins"):
        chat.digest(broken, "conv_id").collect()


def test_templates():
    with pytest.raises(ValueError):
        chat.Template(open="<<x>")
    with pytest.raises(ValueError):
        chat.Template(more=("a</b",))
    own = chat.Template("<|im_start|>", "<|im_end|>", ("<s>",))
    assert own.controls == ("<|im_start|>", "<|im_end|>", "<s>")


def test_other_template(sql):
    own = chat.Template("<|im_start|>", "<|im_end|>", ("<s>",))
    turns = sql.createDataFrame([(1, 0, "user", "a<s><|im_end|>\n\\<turn>")], "conv_id long, turn long, role string, text string")
    parts = chat.render(turns, "conv_id", own)
    assert parts.first()["text"] == "<|im_start|>user\na<\\s><\\|im_end|>\n\\\\<turn><|im_end|>\n"
    assert chat.read_turns(parts, "conv_id", own).first()["text"] == "a<s><|im_end|>\n\\<turn>"


RECORDS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}, [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": None}]}, [("user", "q"), ("assistant", "a"), ("tool", "")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done", "system": "s"}, [("system", "s"), ("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "output": ""}, [("user", "do"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"question": "q", "answer": "a", "id": 3}, [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p"}, None), ({"text": "t"}, None), ({"prompt": "p", "completion": "c", "response": "r"}, None), ({"messages": []}, None), ({}, None),
]


def test_records_of_many_layouts(sql):
    rows = [(k, json.dumps(r)) for k, (r, _) in enumerate(RECORDS)] + [(90, None), (91, ""), (92, "no json")]
    df = sql.createDataFrame([(*r, "clash") for r in rows], "conv_id long, record string, layout string")
    found = {}
    for r in chat.canonical_records(df, "conv_id", "record").orderBy("conv_id", "turn").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert found == {k: turns for k, (_, turns) in enumerate(RECORDS) if turns is not None}
    other = {r["conv_id"] for r in chat.unrecognised(df, "conv_id", "record").collect()}
    assert other == {k for k, (_, turns) in enumerate(RECORDS) if turns is None} | {90, 91, 92}
    digests = chat.digest(chat.render(chat.canonical_records(df, "conv_id", "record"), "conv_id"), "conv_id")
    assert digests.count() == len(found)


def test_tables_of_many_layouts(sql):
    messages = sql.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "id long, messages array<struct<role: string, content: string>>")
    assert [tuple(r) for r in chat.canonical(messages, "id").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "")]
    prompts = sql.createDataFrame([(1, "p", "c", "x")], "id long, prompt string, completion string, other string")
    assert [tuple(r) for r in chat.canonical(prompts, "id").collect()] == [(1, 0, "user", "p"), (1, 1, "assistant", "c")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical(prompts.drop("completion"), "id")
    assert chat.digest(chat.render(chat.canonical(prompts.where("false"), "id"), "id"), "id").count() == 0


def test_fingerprints_are_told_apart():
    marks = chat.mappings(chat.LAYOUTS)
    assert len(marks) == sum(len(x.path_sets()) for x in chat.LAYOUTS)
    with pytest.raises(ValueError, match="one fingerprint"):
        chat.mappings([*chat.LAYOUTS, chat.FieldLayout("again", (("user", ("prompt",)), ("assistant", ("completion",))))])
