"""Web archives packaged in ZIP files: written from pages, and read back by ranges without extraction.

An archive is a ZIP file whose members are stored: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (offset and length of each record). The reader finds the end record, the ZIP64 end record
where there is one, and the central directory; from the local headers it knows where members lie, from the index
where records lie. Runs of neighbouring records, a few megabytes each, become rows that Spark deals to tasks,
and each task reads its ranges only. Archives without an index are read from their WARC members as a whole.

Files are opened through pyarrow's file systems by URI, so archives may lie in any store these know. Names are
unique per attempt, and only names that finished tasks return are read, so repeated tasks do no harm.

Cases: a null payload is empty; ids may be null or repeated; line breaks in addresses are escaped; other columns
are not read; no rows give no archives and no records.
"""

from __future__ import annotations

import base64
import gzip
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import map_batches, written
from evalspark.session import fresh_dir

ARCHIVE_BYTES, RANGE_BYTES, RANGES_PER_TASK = 16_000_000, 4_000_000, 4
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50


class Member(NamedTuple):
    name: str
    method: int
    offset: int  # of its bytes, behind the local header
    size: int


def members(file, size: int) -> list[Member]:
    """The members of the ZIP file ``file`` (anything with seek and read) by its central directory."""

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        found = file.read(n)
        if len(found) < n:
            raise ValueError("the ZIP file is cut short")
        return bytes(found)

    tail = at(max(0, size - 65_557), min(size, 65_557))
    place = len(tail) - 22
    while place >= 0:  # the end record is followed by nothing but its own comment
        if tail[place : place + 4] == END.to_bytes(4, "little") and place + 22 + struct.unpack_from("<H", tail, place + 20)[0] == len(tail):
            break
        place -= 1
    if place < 0:
        raise ValueError("not a ZIP file")
    entries, length, start = struct.unpack_from("<HII", tail, place + 10)
    end_at = size - len(tail) + place
    if 0xFFFF == entries or 0xFFFFFFFF in (length, start):
        if end_at >= 20 and struct.unpack("<I", at(end_at - 20, 4))[0] == LOCATOR64:
            (where,) = struct.unpack("<Q", at(end_at - 12, 8))
            sign, *_, entries, length, start = struct.unpack("<IQHHIIQQQQ", at(where, 56))
            if sign != END64:
                raise ValueError("the ZIP64 end record is missing")
    directory = at(start, length)
    found, p = [], 0
    for _ in range(entries):
        sign, method, packed, full, n_name, n_extra, n_note, header = struct.unpack_from("<I6xH8xIIHHH8xI", directory, p)
        if sign != ENTRY:
            raise ValueError("the central directory is damaged")
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        x = 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # ZIP64: the values whose short fields are full, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            x += 4 + n
        sign, a, b = struct.unpack("<I22xHH", at(header, 30))
        if sign != LOCAL:
            raise ValueError("a local header is missing")
        found.append(Member(name, method, header + 30 + a + b, packed))
        p += 46 + n_name + n_extra + n_note
    return found


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    address = "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Target-URI: {address}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def parse(raw: bytes) -> dict:
    """The fields of one WARC record; its payload is null for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    kind = fields["warc-type"]
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "digest": _hex(fields.get("warc-payload-digest")),
        "payload_bytes": int(headers.get("content-length", len(payload))), "payload": payload if kind == "response" else None,
    }


def plain_length(raw: bytes) -> int:
    """The bytes of the first record of ``raw``, headers and block."""
    head, mark, _ = raw.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    if not mark or size is None:
        raise ValueError("a record without an end of its headers or without a length")
    return len(head) + len(mark) + int(size[1])


def _hex(digest: str | None) -> str | None:
    """A digest field in lower-case hex, from its usual base 32."""
    algorithm, _, value = (digest or "").partition(":")
    if not value:
        return None
    return base64.b32decode(value).hex() if algorithm == "sha1" and len(value) == 32 else value.lower()


RECORD = "record_id string, record_type string, target_uri string, refers_to string, digest string, payload_bytes long, payload binary"


def package(records: list[tuple[str, bytes]]) -> bytes:
    """The bytes of an archive of (address, gzip member) pairs."""
    index, offset = [], 0
    for address, packed in records:
        index.append(f"{address} 19700101000000 " + json.dumps({"url": address, "filename": "data.warc.gz", "offset": str(offset), "length": str(len(packed))}))
        offset += len(packed)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", b"".join(x for _, x in records))
        z.writestr("indexes/index.cdxj", "\n".join(sorted(index)))
        z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
    return out.getvalue()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the pages to archives below the shared folder; (path, records) of each archive.

    Of equal payloads of at least LEAST_REVISIT bytes the one with the largest id is the response and the others
    revisit it; rows that share the largest id are responses all.
    """
    folder = fresh_dir(pages.sparkSession, "archives")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    first = long.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = written(first, "responses")
    is_revisit = F.coalesce(F.col("response").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("response"))), F.lit(False))
    # payloads below the limit have no partner: their digests are not in the table
    told = rows.join(first, "digest", "left").withColumn("is_revisit", is_revisit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        store, base = FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close(held: list[tuple[str, bytes]]) -> dict:
            name = f"{base}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(name) as out:
                out.write(package(held))
            return {"path": pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), "records": pa.array([len(held)], pa.int64())}

        held: list[tuple[str, bytes]] = []
        size = 0
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("id", "url", "payload", "digest", "response", "is_revisit")}
                raw = record(r["id"], r["url"], r["payload"], r["digest"], r["response"], r["is_revisit"])
                packed = gzip.compress(raw, 3, mtime=0)
                held.append(("".join((r["url"] or "about:blank").split()), packed))
                size += len(packed)
                if size >= archive_bytes:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    columns = ["id", "url", "payload", "digest", "response", "is_revisit"]
    return written(map_batches(told.select(columns), run, "path string, records long"), "archive-list")


def _open(path: str):
    store, name = FileSystem.from_uri(path)
    return store.open_input_file(name)


def locate(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, first, records): runs of neighbouring records of each archive, as (offset, length) pairs; a length
    over a whole WARC member stands for all its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with _open(path) as file:
                    stored = members(file, file.size())
                    for m in stored:
                        if m.method != 0 and (m.name.startswith("archive/") and ".warc" in m.name or m.name.startswith("indexes/") and ".cdx" in m.name):
                            raise ValueError(f"{path}: {m.name} is compressed by the archive, so no ranges of it can be read")
                    warcs = {m.name.rsplit("/", 1)[1]: m for m in stored if m.name.startswith("archive/") and ".warc" in m.name}
                    known: dict[str, list[tuple[int, int]]] = {name: [] for name in warcs}
                    for m in stored:
                        if m.name.startswith("indexes/") and ".cdx" in m.name:
                            file.seek(m.offset)
                            text = bytes(file.read(m.size))
                            text = gzip.decompress(text) if m.name.endswith(".gz") else text
                            for line in text.decode("utf-8", "replace").splitlines():
                                if "{" in line:
                                    x = json.loads(line[line.index("{") :])
                                    if x.get("filename") in warcs:
                                        known[x["filename"]].append((warcs[x["filename"]].offset + int(x["offset"]), int(x["length"])))
                for name, spans in known.items():
                    spans = sorted(set(spans)) or [(warcs[name].offset, warcs[name].size)]
                    part: list[tuple[int, int]] = []
                    for span in [*spans, None]:
                        if part and (span is None or span[0] + span[1] - part[0][0] > range_bytes):
                            yield {
                                "path": pa.array([path]), "first": pa.array([part[0][0]], pa.int64()),
                                "records": pa.array([[{"offset": o, "length": n} for o, n in part]], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
                            }
                            part = []
                        if span is not None:
                            part.append(span)

    return map_batches(paths.select("path"), run, "path string, first long, records array<struct<offset: long, length: long>>")


def read_records(paths: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives named in ``path``, read by ranges."""
    ranges = written(locate(paths, range_bytes), "record-ranges")
    # rows are short and what they stand for is not: the number of tasks follows the number of ranges
    tasks = max(1, -(-ranges.count() // RANGES_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for path, first, records in zip(*(b.column(c).to_pylist() for c in ("path", "first", "records")), strict=True):
                with _open(path) as file:
                    file.seek(first)
                    data = bytes(file.read(records[-1]["offset"] + records[-1]["length"] - first))
                found = []
                for r in records:
                    raw = data[r["offset"] - first : r["offset"] - first + r["length"]]
                    while raw:
                        if raw.startswith(b"WARC/"):  # written plainly: its headers tell where it ends
                            end = plain_length(raw)
                            found.append(parse(raw[:end]))
                            raw = raw[end:].lstrip(b"\r\n")
                        else:  # one gzip member per record
                            member = zlib.decompressobj(31)
                            found.append(parse(member.decompress(raw)))
                            raw = member.unused_data
                kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
                yield {c: pa.array([x[c] for x in found], kinds.get(c, pa.string())) for c in (x.split()[0] for x in RECORD.split(", "))}

    return map_batches(ranges.repartition(tasks, "path", "first"), run, RECORD)
