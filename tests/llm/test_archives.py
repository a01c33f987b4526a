"""Archives as others write them: read whole, or refused with an error, never read in part."""

import hashlib
import io
import zipfile
import zlib

import pytest

from evalspark.llm import wacz

PAGES = [(k, f"http://x/{k}", f"<p>page {k}\r\n\r\nWARC/1.1</p>".encode()) for k in range(5)]
RECORDS = [wacz.record(i, url, body, hashlib.sha1(body).hexdigest(), None, False) for i, url, body in PAGES]


def archive(tmp_path, name, data, method=zipfile.ZIP_STORED, index=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr(f"archive/{name}", data)
        if index:
            z.writestr("indexes/index.cdxj", index)
    path = tmp_path / "x.wacz"
    path.write_bytes(out.getvalue())
    return path.as_uri()


def packed(data):
    c = zlib.compressobj(wbits=31)
    return c.compress(data) + c.flush()


@pytest.mark.parametrize("name, make", [("data.warc", bytes), ("data.warc.gz", packed)])
@pytest.mark.parametrize("indexed", [False, True])
def test_records_of_others_are_read(sql, tmp_path, name, make, indexed):
    parts = [make(r) for r in RECORDS]
    at = [sum(map(len, parts[:k])) for k in range(len(parts))]
    index = "\n".join(f'x 1 {{"filename": "{name}", "offset": "{a}", "length": "{len(p)}"}}' for a, p in zip(at, parts, strict=True))
    path = archive(tmp_path, name, b"".join(parts), index=index if indexed else None)
    found = wacz.read_records(sql.createDataFrame([(path,)], "path string")).collect()
    assert sorted((r["target_uri"], bytes(r["payload"])) for r in found) == [(url, body) for _, url, body in PAGES]


def test_compressed_members_are_refused(sql, tmp_path):
    path = archive(tmp_path, "data.warc", b"".join(RECORDS) * 20, method=zipfile.ZIP_DEFLATED)
    with pytest.raises(Exception, match="compressed by the archive"):
        wacz.read_records(sql.createDataFrame([(path,)], "path string")).collect()


def test_records_without_length_are_refused():
    with pytest.raises(ValueError):
        wacz.plain_length(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")
