"""WARC archives of pages: a gzip member for each record, read one after the other with every digest checked."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Size from which an archive is closed (a longer record is an archive of its own size), bytes of a member that are decompressed at
#: once, gzip's level, and payloads below which equal ones are all kept.
ARCHIVE_MB, CHUNK, LEVEL, MIN_BYTES = 8, 1 << 16, 6, 0

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: The pages have no time of their own.
DATE = "2000-01-01T00:00:00Z"

RECORD = "page_id long, url binary, copy long, digest string, n long, first_id long, first_url binary, html binary"
ENTRIES = "archive string, offset long, record_id string, record_type string, target_uri string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, payload binary"


class BadArchive(ValueError):
    """What was read isn't a whole record, or its digest is another one."""


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, url: bytes | None, copy: int, digest: str) -> str:
    """The same for the same page whenever and wherever it is written: UUID, version 5, of what tells records apart."""
    own = bytearray(hashlib.sha1(repr((page_id, url, copy, digest)).encode()).digest()[:16])
    own[6], own[8] = own[6] & 0x0F | 0x50, own[8] & 0x3F | 0x80
    h = own.hex()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def uri(url: bytes) -> bytes:
    """Without what would break a header: blanks, control characters and bytes beyond ASCII are written as %XX."""
    return b"".join(bytes((b,)) if 32 < b < 127 else b"%%%02X" % b for b in url)


def record(page_id: int | None, url: bytes | None, copy: int, digest: str, n: int, payload: bytes | None, first: tuple[int | None, bytes | None] | None = None, level: int = LEVEL) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit of `first` (page_id and url) without it."""
    block = HTTP % n + (payload or b"")
    payload_digest = base32(bytes.fromhex(digest)).encode()
    head = [
        (b"WARC-Type", b"revisit" if first else b"response"), (b"WARC-Record-ID", record_id(page_id, url, copy, digest).encode()), (b"WARC-Date", DATE.encode()),
        (b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", b"%d" % len(block)), (b"WARC-Block-Digest", b"sha1:" + base32(hashlib.sha1(block).digest()).encode()), (b"WARC-Payload-Digest", b"sha1:" + payload_digest),
    ]
    if url is not None:
        head.append((b"WARC-Target-URI", uri(url)))
    if page_id is not None:
        head.append((b"X-Page-ID", b"%d" % page_id))
    if first:
        head += [(b"WARC-Refers-To", record_id(*first, 1, digest).encode()), (b"WARC-Profile", REVISIT_PROFILE)]
    whole = VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    member = zlib.compressobj(level, zlib.DEFLATED, 31)
    return member.compress(whole) + member.flush()


def members(stream, chunk: int = CHUNK):
    """Offset and content of each gzip member of a stream, which is read a chunk at a time."""
    rest, at = b"", 0
    while True:
        member, parts, used = zlib.decompressobj(31), [], 0
        while not member.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if used:
                    raise BadArchive(f"the member at {at} is cut off")
                return
            used += len(data)
            try:
                parts.append(member.decompress(data))
            except zlib.error as e:
                raise BadArchive(f"the member at {at} can't be decompressed: {e}") from e
        rest = member.unused_data
        yield at, b"".join(parts)
        at += used - len(rest)


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadArchive(f"not a header: {line[:80]!r}")
        out[name.decode("latin-1").strip().lower()] = value.decode("latin-1").strip()
    return out


def checked(stated: str | None, data: bytes, what: str) -> str:
    found = base32(hashlib.sha1(data).digest())
    if stated != f"sha1:{found}":
        raise BadArchive(f"{what}: {stated} is stated, sha1:{found} was read")
    return found


def records(stream, chunk: int = CHUNK):
    """Offset, headers, HTTP headers and payload (None of a revisit) of each record, framed by its Content-Length; the digests of
    blocks and payloads are those that the headers state."""
    for at, whole in members(stream, chunk):
        head, blank, rest = whole.partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        if not blank or version not in (b"WARC/1.0", VERSION):
            raise BadArchive(f"no record at {at}")
        of = headers(lines)
        length = of.get("content-length", "")
        if not length.isdecimal() or rest[int(length) :] != b"\r\n\r\n":
            raise BadArchive(f"the record at {at} isn't {length or 'of a stated number of'} bytes long")
        block = rest[: int(length)]
        checked(of.get("warc-block-digest"), block, f"block of the record at {at}")
        http, blank, payload = block.partition(b"\r\n\r\n")
        status, _, lines = http.partition(b"\r\n")
        if not blank or not status.startswith(b"HTTP/"):
            raise BadArchive(f"no HTTP response at {at}")
        its = headers(lines)
        if of.get("warc-type") == "revisit":
            if payload:
                raise BadArchive(f"the revisit at {at} has a payload")
            payload = None
        else:
            checked(of.get("warc-payload-digest"), payload, f"payload of the record at {at}")
            if its.get("content-length") != str(len(payload)):
                raise BadArchive(f"the payload at {at} has {len(payload)} bytes, not {its.get('content-length')}")
        yield at, of, its, payload


def _write(archive_bytes: int, level: int):
    def run(batches):
        parts, size, first = [], 0, None

        def done():
            content = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([f"{first}.warc.gz"]), pa.array([len(parts)], pa.int64()), pa.array([content], pa.binary())], ["archive", "records", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, copy, digest, n, first_id, first_url, html = (batch[c][i].as_py() for c in ("page_id", "url", "copy", "digest", "n", "first_id", "first_url", "html"))
                parts.append(record(page_id, url, copy, digest, n, html, None if html is not None else (first_id, first_url), level))
                first = first or record_id(page_id, url, copy, digest)[10:-1]
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield done()
                    parts, size, first = [], 0, None
        if parts:
            yield done()

    return run


def _read(payloads: bool):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out, name = [], batch["archive"][i].as_py()
                for at, of, its, payload in records(io.BytesIO(batch["content"][i].as_buffer())):
                    page_id = of.get("x-page-id")
                    out.append((name, at, of["warc-record-id"], of["warc-type"], of.get("warc-target-uri"), None if page_id is None else int(page_id), int(its["content-length"]), of["warc-payload-digest"].removeprefix("sha1:"), of.get("warc-refers-to"), payload if payloads else None))
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ENTRIES.split(", ")])

    return run


def captures(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The records to write, as RECORD: those with html are responses, the others revisits of first_id and first_url.

    Equal rows are counted where they are read and told apart by their number (copy), so that a page that is a third of all rows isn't
    shuffled row by row. A payload is shuffled once however many pages have it.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("binary").alias("url"), html.alias("html"))
    base = base.withColumns({"digest": F.sha1("html"), "n": F.octet_length("html").cast("long")})
    numbered = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    same = F.col("n") >= min_bytes
    pages_of = written(base.where(same).groupBy("page_id", "url", "digest", "n").agg(F.count("*").alias("copies")))
    firsts = written(pages_of.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first")))
    of_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("copy") == 1)
    every = pages_of.select("*", numbered).join(firsts, "digest").withColumn("is_first", of_first)
    columns = ("page_id", "url", "copy", "digest", "n", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "html")
    payloads = base.where(same).groupBy("digest").agg(F.min("html").alias("html"))
    responses = every.where("is_first").join(payloads, "digest").select(*columns)
    revisits = every.where("not is_first").withColumn("html", F.lit(None).cast("binary")).select(*columns)
    small = base.where(~same).groupBy("page_id", "url", "digest", "n", "html").agg(F.count("*").alias("copies")).select("*", numbered)
    small = small.withColumn("first", F.struct("page_id", "url")).select(*columns)
    return responses.unionByName(revisits).unionByName(small)


def archives(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_mb: float = ARCHIVE_MB, level: int = LEVEL) -> DataFrame:
    """archive (name), records, content: WARC archives with a record for each row of pages (page_id, url, html)."""
    return captures(pages, min_bytes).mapInArrow(_write(int(archive_mb * 1e6), level), "archive string, records long, content binary")


def entries(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of archives (archive, content) as ENTRIES, with their payloads or without. A damaged archive is an error."""
    return files.select("archive", "content").mapInArrow(_read(payloads), ENTRIES)


def save_files(files: DataFrame, folder: str) -> DataFrame:
    """archive, path: the archives as files in a folder that all executors can write to (a local path, or a URI that
    pyarrow.fs knows). A file gets its name when it is whole, so a task that is run again only writes the same file again."""

    def run(batches):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            names = batch["archive"].to_pylist()
            for i, name in enumerate(names):
                part = f"{path}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(batch["content"][i].as_buffer())
                store.move(part, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([batch["archive"], pa.array([f"{path}/{n}" for n in names], pa.string())], ["archive", "path"])

    return files.select("archive", "content").mapInArrow(run, "archive string, path string")


def load_files(spark: SparkSession, folder: str) -> DataFrame:
    """archive, content of the *.warc.gz files in a folder, by Spark's own reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


def resolved(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of entries (a table): a revisit gets the page_id of
    the response that it names, if that has the same payload."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    responses = read.where("record_type = 'response'")
    of = responses.select(F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("its"), F.col("payload_bytes").alias("its_bytes"), F.col("page_id").alias("its_page"))
    same = (F.col("payload_digest") == F.col("its")) & (F.col("payload_bytes") == F.col("its_bytes"))
    revisits = read.where("record_type = 'revisit'").join(of, "refers_to_id", "left").withColumn("refers_to", F.when(same, F.col("its_page")))
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.select(*columns))


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_mb: float = ARCHIVE_MB) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of what was written and read back: one row a page.

    Of pages with the same html of min_bytes or more the one with the largest page_id is a response, and the others revisit it; of
    rows with this page_id that with the largest url, and of equal rows one. A missing page_id is smaller than all others (refers_to is
    then null), a missing html is empty, a missing url has no header. An empty table gives no row; other columns are ignored.
    The archives are a table in the shared folder, written with Spark's own commit, so a lost task leaves no half of an archive.
    """
    files = written(archives(pages, min_bytes, archive_mb))
    return resolved(written(entries(files).drop("payload")))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).drop("target_uri")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - i % 4 * 5) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN largest END AS refers_to FROM r
"""
