"""WARC archives: a writer and a sequential reader, one gzip member per record.

Archives go through Arrow's file systems (``file:``, ``hdfs:``, ``s3:`` and
others by URI), so writers and readers on any machine see the same shared store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernmill.llm.scratch import few, new_path, written

#: Bytes read and inflated at a time. One record is held at a time, in a few copies.
CHUNK = 1 << 20
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:fernmill:warc")


class WarcError(ValueError):
    """An archive that breaks the format or fails its digest."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, copy: str | None = None) -> str:
    """The id of a page's record; ``copy`` tells rows that repeat a page apart."""
    return f"<{uuid.uuid5(NAMESPACE, str(page_id) if copy is None else f'{page_id} {copy}').urn}>"


def _one_line(value: object) -> str:
    """A header value: white space and control characters become one space each."""
    return "".join(" " if ord(c) < 33 or ord(c) == 127 else c for c in str(value)).strip()


def make_record(page_id: object, url: str | None, payload: bytes, refers_to: object = None, copy: str | None = None) -> bytes:
    """One gzip member: a response with the payload, or a revisit without it.

    A revisit keeps the HTTP head, whose Content-Length is the payload's, and
    names the record that has the payload.
    """
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, copy)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_one_line(url)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        *([] if page_id is None else [f"X-Page-Id: {quote(str(page_id))}"]),
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {quote(str(refers_to))}"]
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return b"".join((squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n"), squeeze.compress(block), squeeze.compress(b"\r\n\r\n"), squeeze.flush()))


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated chunks of each gzip member of a stream, in order."""
    held = stream.read(CHUNK)
    while held:
        inflate = zlib.decompressobj(31)

        def chunks() -> Iterator[bytes]:
            nonlocal held
            while not inflate.eof:
                if not held:
                    held = stream.read(CHUNK)
                    if not held:
                        raise WarcError("the archive ends inside a gzip member")
                try:
                    out = inflate.decompress(held, CHUNK)
                except zlib.error as e:
                    raise WarcError(f"not a gzip member: {e}") from e
                held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                if out:
                    yield out

        part = chunks()
        yield part
        for _ in part:  # whatever the caller left unread
            pass
        if not held:
            held = stream.read(CHUNK)


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of each record of an open archive.

    Framing is by Content-Length: a member must hold one header block, as many
    bytes as it says and the closing two line ends. Block digests are verified
    for all records, payload digests where the payload is there.
    """
    for chunks in _members(stream):
        buffer = bytearray()
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            part = next(chunks, None)
            if part is None:
                raise WarcError("a record without a complete header")
            buffer += part
        version, head = _headers(bytes(buffer[:end]))
        if not version.startswith("WARC/"):
            raise WarcError(f"not a WARC record: {version[:40]!r}")
        del buffer[: end + 4]
        length = int(head["content-length"])
        for part in chunks:
            buffer += part
        if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
            raise WarcError(f"Content-Length is {length}, the member has {len(buffer) - 4}")
        del buffer[length:]
        block = bytes(buffer)
        if (said := head.get("warc-block-digest")) and said != f"sha1:{base32_sha1(block)}":
            raise WarcError(f"block digest differs in {head.get('warc-record-id')}")
        http_head, _, payload = block.partition(b"\r\n\r\n")
        if head["warc-type"] == "response" and head["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise WarcError(f"payload digest differs in {head.get('warc-record-id')}")
        yield head, _headers(http_head)[1], payload


def _writer(folder: str, roll_bytes: int):
    """Writes archives of about ``roll_bytes``; returns a row for each. A repeated
    task writes files of other names, and only those of the task that counted
    reach the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to, copy in zip(*(batch.column(i) for i in range(5)), strict=True):
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = make_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), copy.as_py())
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, roll_bytes: int = 256 << 20) -> DataFrame:
    """Write one record per row under ``folder``; return the manifest (path, records, bytes).

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with
    the smallest page_id is the response and the others are revisits of it;
    smaller payloads are all responses. Of rows that repeat that page_id, the
    one with the smallest url (null first) is the response, and of rows alike in
    all, one. A null payload is an empty one, and a null page_id is a response
    that nothing revisits unless an equal payload has an id. Ids may be of any
    type that goes to a string and back. The manifest has a row per file.

    Ids and digests are shuffled to find the first of each payload; payloads are
    only where the list of revisits is too long to broadcast, and for pages that
    repeat.
    """
    html_of = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), html_of.alias("html"), F.when(F.octet_length(html_of) >= min_revisit_bytes, F.sha1(F.encode(html_of, "utf-8"))).alias("digest"))
    keyed = written(rows.where(F.col("digest").isNotNull()).groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.min(_named("url")).alias("least")), "warc-pages")
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1 and first is not null")
    # A row for each page that revisits another or repeats: its first, and whether it is that itself.
    marks = keyed.join(few(written(firsts.select("digest", "first"), "warc-firsts")), "digest")
    same = F.col("page_id").eqNullSafe(F.col("first"))
    marks = written(marks.where(~same | (F.col("n") > 1)).select(F.col("page_id").alias("m_id"), F.col("digest").alias("m_digest"), "first", same.alias("own"), "least", (F.col("n") > 1).alias("repeats")), "warc-marks")
    joined = F.col("page_id").eqNullSafe(F.col("m_id")) & (F.col("digest") == F.col("m_digest"))
    plain = rows.join(few(marks), joined, "left").where("not coalesce(repeats, false)").select("page_id", "url", "html", F.col("first").alias("refers_to"), F.lit(None).cast("string").alias("copy"))
    # Rows that repeat a page are counted by url, so that however many there are, no task gets them all.
    again = rows.join(few(marks.where("repeats")), joined).groupBy("page_id", "digest", "url", "first", "own", "least").agg(F.count("*").alias("n"), F.first("html").alias("html"))
    again = again.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    response = F.col("own") & (F.col("k") == 1) & (_named("url") == F.col("least"))
    again = again.select("page_id", "url", "html", F.when(~response, F.col("first")).alias("refers_to"), F.when(~response, F.concat_ws(" ", F.col("k").cast("string"), "url")).alias("copy"))
    out = plain.unionAll(again).select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"), "copy")
    return out.mapInArrow(_writer(folder, roll_bytes), "path string, records long, bytes long")


def _named(column: str):
    """A column as a struct that orders null first and compares it as a value."""
    return F.struct(F.col(column).isNotNull().alias("there"), F.coalesce(F.col(column), F.lit("")).alias("value"))


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _read_one(path, records, payloads)

    return run


def _read_one(path: str, records: int, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, base = fs.FileSystem.from_uri(path)
    seen, rows, held = 0, [], 0

    def flush() -> pa.RecordBatch:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    with store.open_input_stream(base, compression=None) as stream:
        for head, http, payload in read_records(stream):
            named = lambda k: unquote(head[k]) if k in head else None
            response = head["warc-type"] == "response"
            if response and len(payload) != int(http["content-length"]):
                raise WarcError(f"HTTP length differs in {head['warc-record-id']}")
            rows.append((named("x-page-id"), head.get("warc-target-uri"), head["warc-type"], int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"), named("x-refers-to-page-id"), payload if response and payloads else None))
            seen, held = seen + 1, held + len(payload)
            if held >= 8 * CHUNK or len(rows) >= 4096:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()
    if seen != records:
        raise WarcError(f"{path} has {seen} records, {records} were written")


RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in a manifest (path, records).

    Each archive is read from start to end by one task. ``payload`` is null for
    revisits, and for all records if ``payloads`` is false (every payload is
    still inflated and verified); payload_bytes and payload_digest are those of
    the full payload for both kinds. A damaged archive raises WarcError.
    """
    return manifest.select("path", "records").mapInArrow(_reader(payloads), RECORDS)


def round_trip(pages: DataFrame, label: str = "warc", payloads: bool = True, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return the records read back.

    The manifest is collected: a row for each file, so a few for each task. An
    empty table gives no archive and no records.
    """
    spark, kind = pages.sparkSession, pages.schema[options.get("page_id", "page_id")].dataType
    made = write_archives(pages, new_path(spark, label), **options).collect()
    manifest = spark.createDataFrame(made, "path string, records long, bytes long")
    found = read_archives(manifest.repartition(max(1, len(made))), payloads)
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGIT = "substr('" + _BASE32 + "', (x // {0} % 32 + 1)::BIGINT, 1)"
#: The registered query in DuckDB's SQL: the digest's base32 digits are taken from five hexadecimal digits at a time.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
c AS (SELECT *, list_transform([1, 6, 11, 16, 21, 26, 31, 36], lambda i: ('0x' || substr(h, i, 5))::BIGINT) AS v FROM d),
b AS (SELECT *, array_to_string(list_transform(v, lambda x: {" || ".join(_DIGIT.format(n) for n in (32768, 1024, 32, 1))}), '') AS payload_digest FROM c),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
