"""Chat formatting by schema fingerprints.

Records of chats come in many layouts. The nested field paths of a record (``messages[].role``), as far as any registered
layout knows them, are sorted and hashed; the hash selects a declarative mapping, which turns the record into
canonical turns (conversation, turn, role, text). A table whose schema has such paths is mapped as a whole; a column of
JSON records is mapped row by row, by built-in functions only, and may mix layouts.

``render`` writes a conversation by a template that marks its turns. Control strings inside texts get a backslash behind their
first sign and a backslash is doubled, so no control string of the template ever stands in a text, and dropping each
backslash before a sign gives the text back. The loss mask is a list of [start, end) spans over the written text, one
per assistant text.

Turns are sorted inside hash partitions and written one after another: memory is bounded by a part, which holds whole turns
of one conversation up to ``part_chars`` (or one longer turn); nearly all conversations are one part. Reading back goes
through the parts in order and holds no conversation either. One conversation is in one task, for its digest runs over all
of its text in order.

Cases: a null text is empty, a null role too; a null id is a conversation of its own; turns with one number are ordered by
role and text and all kept, repeated rows too; a null turn number comes first; other columns are not read; no rows give
no rows. Records whose fingerprint is not registered give no turns and are listed by ``unrecognised``.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.llm.frames import map_batches

PART_CHARS = 1_000_000
_TURN = "turn long, role string, text string"


# -- layouts and their fingerprints ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ListLayout:
    """A list of messages, each with a role and a text."""

    name: str
    items: str
    role: str
    text: str
    roles: dict[str, str] = field(default_factory=dict)

    def path_sets(self) -> list[set[str]]:
        return [{f"{self.items}[]", f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}]

    def schema(self) -> list[T.StructField]:
        item = T.StructType([T.StructField(self.role, T.StringType()), T.StructField(self.text, T.StringType())])
        return [T.StructField(self.items, T.ArrayType(item))]

    def turns(self, record) -> Column:
        renamed = lambda c: F.coalesce(*[F.when(c == old, F.lit(new)) for old, new in self.roles.items()], c)
        return F.transform(
            record(self.items), lambda x, i: F.struct(i.cast("long").alias("turn"), renamed(x[self.role]).alias("role"), x[self.text].alias("text"))
        )


@dataclass(frozen=True)
class FieldLayout:
    """One field or several joined fields per turn, in order; optional fields may be missing."""

    name: str
    fields: tuple[tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()
    joiner: str = "\n\n"

    def path_sets(self) -> list[set[str]]:
        needed = {f for _, names in self.fields for f in names} - set(self.optional)
        some = itertools.chain.from_iterable(itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [needed | set(x) for x in some]

    def schema(self) -> list[T.StructField]:
        return [T.StructField(f, T.StringType()) for _, names in self.fields for f in names]

    def turns(self, record) -> Column:
        found = []
        for role, names in self.fields:
            filled = F.filter(F.array(*[record(f) for f in names]), lambda x: F.coalesce(x, F.lit("")) != "")
            present = F.coalesce(*[record(f) for f in names]).isNotNull()
            found.append(F.when(present, F.struct(F.lit(role).alias("role"), F.array_join(filled, self.joiner).alias("text"))))
        held = F.filter(F.array(*found), lambda x: x.isNotNull())
        return F.transform(held, lambda x, i: F.struct(i.cast("long").alias("turn"), x["role"].alias("role"), x["text"].alias("text")))


@dataclass(frozen=True)
class RowLayout:
    """A table with a row per turn; only whole tables have it."""

    name: str
    turn: str
    role: str
    text: str

    def path_sets(self) -> list[set[str]]:
        return [{self.turn, self.role, self.text}]


LAYOUTS = (
    RowLayout("rows", "turn", "role", "text"),
    ListLayout("messages", "messages", "role", "content"),
    ListLayout("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    FieldLayout("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), ("system", "input")),
    FieldLayout("prompt", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), ("system",)),
    FieldLayout("response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), ("system",)),
    FieldLayout("question", (("user", ("context", "question")), ("assistant", ("answer",))), ("context",)),
)


def fingerprint(paths) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def mappings(layouts) -> dict[str, object]:
    """The layout of each registered fingerprint."""
    found: dict[str, object] = {}
    for layout in layouts:
        for paths in layout.path_sets():
            other = found.setdefault(fingerprint(paths), layout)
            if other is not layout:
                raise ValueError(f"layouts {other.name} and {layout.name} have one fingerprint")
    return found


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a type, list items marked by ``[]``."""
    if isinstance(kind, T.StructType):
        return set().union(*[field_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return {f"{at}[]"} | (field_paths(kind.elementType, f"{at}[]") if isinstance(kind.elementType, T.StructType) else set())
    return {at}


def _known(layouts) -> set[str]:
    return set().union(*[paths for layout in layouts for paths in layout.path_sets()])


def _exploded(df: DataFrame, id_col: str, turns: Column) -> DataFrame:
    listed = df.select(F.col(id_col).alias(id_col), F.explode(turns).alias("t"))
    return listed.select(id_col, "t.turn", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def canonical(df: DataFrame, id_col: str, layouts=LAYOUTS) -> DataFrame:
    """``id_col``, turn, role, text of a table whose schema's fingerprint is registered; other columns don't matter."""
    paths = field_paths(df.drop(id_col).schema) & _known(layouts)
    layout = mappings(layouts).get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"no layout has the field paths {sorted(paths)}")
    if isinstance(layout, RowLayout):
        said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        return df.select(F.col(id_col), F.col(layout.turn).cast("long").alias("turn"), said(layout.role).alias("role"), said(layout.text).alias("text"))
    held = lambda name: F.col(name).cast("string") if isinstance(layout, FieldLayout) else F.col(name)
    return _exploded(df, id_col, layout.turns(lambda name: held(name) if name in df.columns else F.lit(None).cast("string")))


def _has(name: str):
    return lambda x: x[name].isNotNull()


def _parsed(df: DataFrame, id_col: str, record_col: str, layouts) -> tuple[DataFrame, list]:
    """(id, r: the fields that layouts know, fingerprint, layout) of JSON records."""
    rowwise = [x for x in layouts if not isinstance(x, RowLayout)]
    fields = {f.name: f for layout in rowwise for f in layout.schema()}
    present: dict[str, Column] = {}
    for path in _known(rowwise):
        top, _, inner = path.partition("[]")
        one = F.col("r")[top]
        if inner:
            present[path] = F.exists(one, _has(inner[1:]))
        else:
            present[path] = one.isNotNull()
    held = F.concat_ws("\n", *[F.when(present[path], F.lit(path)) for path in sorted(present)])
    marks = mappings(rowwise)
    chosen = F.create_map(*[F.lit(x) for mark, layout in marks.items() for x in (mark, layout.name)])
    rows = df.select(F.col(id_col).alias(id_col), F.from_json(F.col(record_col), T.StructType(list(fields.values()))).alias("r"))
    rows = rows.withColumn("fingerprint", F.substring(F.sha2(held, 256), 1, 16))
    return rows.withColumn("layout", F.try_element_at(chosen, F.col("fingerprint"))), rowwise


def canonical_records(df: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """``id_col``, turn, role, text of a column of JSON records, each mapped by its own fingerprint."""
    rows, rowwise = _parsed(df, id_col, record_col, layouts)
    of = lambda name: F.col("r")[name]
    turns = F.coalesce(*[F.when(F.col("layout") == x.name, x.turns(of)) for x in rowwise])
    return _exploded(rows.where("layout is not null"), id_col, turns)


def unrecognised(df: DataFrame, id_col: str, record_col: str, layouts=LAYOUTS) -> DataFrame:
    """``id_col`` and fingerprint of the records that no mapping fits."""
    return _parsed(df, id_col, record_col, layouts)[0].where("layout is null").select(id_col, "fingerprint")


# -- the template ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """``open`` role, line break, text ``close``, line break; ``more`` control strings are escaped in texts too."""

    open: str = "<turn>"
    close: str = "</turn>"
    more: tuple[str, ...] = ()

    def __post_init__(self):
        for one in self.controls:
            if len(one) < 2 or any(one[0] in other[1:] for other in self.controls) or "\\" in one or "\n" in one:
                raise ValueError("the first sign of a control string may stand nowhere else in one, nor may a backslash or a line break")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.close, *self.more)

    def escaped(self, c: Column) -> Column:
        c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        for one in self.controls:
            c = F.replace(c, F.lit(one), F.lit(f"{one[0]}\\{one[1:]}"))
        return c

    def pattern(self) -> re.Pattern:
        """A written turn. A text holds no control string, so the first ``close`` ends it."""
        return re.compile(re.escape(self.open) + r"((?:[^\\\n]|\\.)*+)\n(.*?)" + re.escape(self.close) + r"\n", re.DOTALL)


TEMPLATE = Template()
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: DataFrame, id_col: str, template: Template = TEMPLATE, trained: tuple[str, ...] = ("assistant",), part_chars: int = PART_CHARS) -> DataFrame:
    """``id_col``, part (from 0), text and loss (spans in the part's text) of every conversation, its parts in order in one partition."""
    role = F.replace(template.escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head = F.concat(F.lit(template.open), role, F.lit("\n"))
    ordered = turns.repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")
    written = ordered.select(
        F.col(id_col).alias("id"), head.alias("head"), template.escaped(F.col("text")).alias("body"), F.col("role").isin(*trained).alias("trained")
    )
    tail = template.close + "\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key: object = None
        part, size = -1, 0  # no conversation yet
        pieces: list[str] = []
        spans: list[dict] = []

        def done(rows: list[tuple]) -> dict:
            ids, numbers, texts, losses = zip(*rows, strict=True) if rows else ((), (), (), ())
            return {
                "id": pa.array(ids, kind), "part": pa.array(numbers, pa.int64()), "text": pa.array(texts, pa.string()),
                "loss": pa.array(losses, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }

        kind = None
        for b in batches:
            kind = b.schema.field("id").type
            out: list[tuple] = []
            held = 0
            for i, head, body, learnt in zip(*(b.column(c).to_pylist() for c in ("id", "head", "body", "trained")), strict=True):
                length = len(head) + len(body) + len(tail)
                if part < 0 or i != key or size + length > part_chars and size:
                    if part >= 0:
                        out.append((key, part, "".join(pieces), spans))
                        held += size
                    part = part + 1 if part >= 0 and i == key else 0
                    key, size, pieces, spans = i, 0, [], []
                    if held > part_chars:
                        yield done(out)
                        out, held = [], 0
                if learnt:
                    spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
                pieces += (head, body, tail)
                size += length
            yield done(out)
        if part >= 0:
            yield done([(key, part, "".join(pieces), spans)])

    id_kind = written.schema["id"].dataType.simpleString()
    found = map_batches(written, run, f"id {id_kind}, part long, text string, loss array<struct<start: long, end: long>>")
    return found.withColumnRenamed("id", id_col)


def read_turns(parts: DataFrame, id_col: str, template: Template = TEMPLATE) -> DataFrame:
    """``id_col``, part, nth (turn of the part, from 0), role, text and trained, read back from written parts."""
    rows = parts.select(F.col(id_col).alias("id"), "part", "text", "loss")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        turn = template.pattern()
        for b in batches:
            for k, (text, loss) in enumerate(zip(b.column("text").to_pylist(), b.column("loss").to_pylist(), strict=True)):
                found = parse(turn, text)
                learnt = {(x["start"], x["end"]) for x in loss}
                yield {
                    "id": pa.concat_arrays([b.column("id").slice(k, 1)] * len(found)), "part": pa.concat_arrays([b.column("part").slice(k, 1)] * len(found)),
                    "nth": pa.array(range(len(found)), pa.int64()), "role": pa.array([unescaped(m[1]) for m in found]),
                    "text": pa.array([unescaped(m[2]) for m in found]), "trained": pa.array([m.span(2) in learnt for m in found]),
                }

    return map_batches(rows, run, f"id {kind}, part long, nth long, role string, text string, trained boolean").withColumnRenamed("id", id_col)


def parse(turn: re.Pattern, text: str) -> list[re.Match]:
    """The written turns of a part, which they must cover."""
    found, at = [], 0
    while at < len(text):
        m = turn.match(text, at)
        if m is None:
            raise ValueError(f"no turn begins at character {at}")
        found.append(m)
        at = m.end()
    return found


def digest(parts: DataFrame, id_col: str, template: Template = TEMPLATE) -> DataFrame:
    """``id_col``, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from parts as ``render`` orders them.

    A conversation's parts must follow one another in one partition; ``render`` gives them so, and other tables are
    sorted by ``in_order`` first.
    """
    rows = parts.select(F.col(id_col).alias("id"), "part", "text", "loss")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        turn = template.pattern()
        key: object = None
        state: list | None = None  # turns, their digest, characters under the mask, their digest, all characters

        def done(rows: list[tuple]) -> dict:
            ids, states = zip(*rows, strict=True) if rows else ((), ())
            return {
                "id": pa.array(ids, id_type), "n_turns": pa.array([s[0] for s in states], pa.int64()),
                "turns_sha256": pa.array([s[1].hexdigest() for s in states], pa.string()), "loss_chars": pa.array([s[2] for s in states], pa.int64()),
                "loss_sha256": pa.array([s[3].hexdigest() for s in states], pa.string()), "formatted_chars": pa.array([s[4] for s in states], pa.int64()),
            }

        id_type = None
        for b in batches:
            id_type = b.schema.field("id").type
            out: list[tuple] = []
            for i, part, text, loss in zip(*(b.column(c).to_pylist() for c in ("id", "part", "text", "loss")), strict=True):
                if part == 0:
                    if state is not None:
                        out.append((key, state))
                    key, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                elif state is None or i != key:
                    raise ValueError("the parts of a conversation are not in order")
                for m in parse(turn, text):
                    state[0] += 1
                    state[1].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                for span in loss:
                    learnt = unescaped(text[span["start"] : span["end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            yield done(out)
        if state is not None:
            yield done([(key, state)])

    schema = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


def in_order(parts: DataFrame, id_col: str) -> DataFrame:
    """Parts from anywhere, each conversation's one after another."""
    return parts.repartition(id_col).sortWithinPartitions(id_col, "part")
