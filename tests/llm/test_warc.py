"""WARC archives against plain versions, on odd rows and damaged bytes."""

import base64
import collections
import hashlib
import io
import pathlib
import zlib

import pytest
from pyspark.sql import functions as F

from quillon.llm import warc
from quillon.llm.common import written

PAGES = "page_id long, url string, html string, archive string, payload int, digest int"
LONG = "<p>" + "x" * 4_000_000 + "</p>"


def page_rows():
    html = [None, "", "a", "b", "é€🙂\r\n\r\nb", "a\0\r\n", LONG, LONG]
    out = [(i, f"http://h/{i} x\r\nEvil: 1" if i % 3 else None, html[i % len(html)], "n", 1, 2) for i in range(40)]
    return out + [out[5]] * 3 + [(None, "u", "a", "n", 1, 2)] * 2 + [(None, "u", "only null", "n", 1, 2)] * 2 + [(38, "z", html[38 % 8], "n", 1, 2)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(page_rows(), PAGES).repartition(3).cache()


def expected(least):
    groups = collections.defaultdict(list)
    for i, url, html, *_ in page_rows():
        groups[(html or "").encode()].append((i, url))
    out = []
    for payload, its in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = max((i for i, _ in its if i is not None), default=None)
        shown = len(its) if len(payload) < least else 1
        for k, (i, _) in enumerate(sorted(its, key=lambda x: (x[0] is None, -(x[0] or 0)))):
            out.append((i, len(payload), digest, "response" if k < shown else "revisit", None if k < shown else first))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.drop("target_uri").collect()), key=str)


@pytest.mark.parametrize("least", [0, 1, 2, 10])
def test_archived(pages, least):
    assert found(warc.archived(pages, least, archive_mb=0.001 if least == 1 else 8)) == expected(least)


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).collect() == []


def test_files_can_be_read_by_others(spark, pages, tmp_path):
    files = written(warc.archives(pages, archive_mb=0.01))
    paths = warc.save_files(files, str(tmp_path / "w")).collect()
    assert len(paths) == files.count() and files.agg(F.sum("records")).first()[0] == len(page_rows())
    back = warc.load_files(spark, str(tmp_path / "w"))
    read = written(warc.entries(back, payloads=True))
    assert found(warc.resolved(read)) == expected(0)
    its = {bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    assert its == {(html or "").encode() for _, _, html, *_ in page_rows()}
    uris = {r.target_uri for r in read.collect()}
    assert None in uris and not any(" " in u or "\n" in u for u in uris if u)
    assert read.select("record_id").distinct().count() == len(page_rows()), "no id twice"
    one = pathlib.Path(paths[0].path).read_bytes()
    assert len(list(warc.members(io.BytesIO(one)))) >= 1 and zlib.decompressobj(31).decompress(one).startswith(b"WARC/1.1\r\nWARC-Type: ")


def plain_record(body=b"<html>", stated=None, length=None, revisit=False):
    http = b"HTTP/1.0 200 OK\r\nServer: a\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + (b"" if revisit else body)
    sha = lambda x: b"sha1:" + base64.b32encode(hashlib.sha1(x).digest())
    head = [b"WARC/1.0", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: <urn:x>", b"warc-payload-digest:" + (stated or sha(body)), b"WARC-Block-Digest: " + sha(block), b"Content-Length: %d" % (length if length is not None else len(block))]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gz(data):
    member = zlib.compressobj(9, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_reader_of_foreign_records(chunk):
    data = gz(plain_record()) + gz(plain_record(b"", revisit=True)) + gz(plain_record(b"x" * 999))
    got = list(warc.records(io.BytesIO(data), chunk))
    assert [p for *_, p in got] == [b"<html>", None, b"x" * 999]
    assert [at for at, *_ in got] == [0, len(gz(plain_record())), len(gz(plain_record()) + gz(plain_record(b"", revisit=True)))]


@pytest.mark.parametrize("data", [
    gz(plain_record())[:-3], gz(plain_record()) + b"junk", gz(plain_record(length=3)), gz(plain_record(stated=b"sha1:AAAA")), gz(plain_record()[:-2]), gz(b"nothing\r\n\r\n"), gz(plain_record().replace(b"<html>", b"<HTML>")),
    gz(plain_record().replace(b"Content-Length: ", b"Content-Size: ")), gz(plain_record())[:40] + b"\0" * 20 + gz(plain_record())[60:],
])
def test_damage_is_an_error(data):
    with pytest.raises(warc.BadArchive):
        list(warc.records(io.BytesIO(data)))
