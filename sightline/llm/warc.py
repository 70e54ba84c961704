"""WARC archives of pages with a two-level capture index.

Method. Pages become WARC records in gzip members, one archive a task. The index sorts
captures by URL with the host reversed, packs them in compressed blocks of
``BLOCK_LINES`` lines, and keeps a sparse directory with one row a block. A lookup
finds the index part of a key among the parts' bounds, binary-searches the directory of
that part, reads the blocks that can hold the key by their byte range, and then the
records by theirs.

Archives and blocks are written to the shared folder by name of the attempt; the table
that lists them is written once all are there, so a task that runs again leaves a file
that nothing names. Nothing passes through the driver but the bounds of the parts, two
keys for each of at most ``spark.sql.shuffle.partitions`` parts.

Defined results: null html is an empty payload; a null url is kept as ``urn:page:`` and
the page's id; rows that repeat a page_id are records of their own, all responses or all
revisits; a row without page_id is a response. Of equal payloads of at least
``LEAST_REVISIT`` bytes the smallest page_id is the response and the others revisit it.
An empty table gives no record. Extra columns are left alone.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import arrow_batches, shared, table
from sightline.session import scratch_path

LEAST_REVISIT = 100
BLOCK_LINES = 3000
#: Pages name no time of capture.
DATE = "1970-01-01T00:00:00Z"


def url_key(url: str) -> str:
    """The url with its host reversed: ``com,example,www)/path?query``, lower-cased up to the path."""
    text = url.split("#", 1)[0].strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        host = ""
    if not host:
        return quote(text, safe="%/:?&=,;+@!$'()*[]~")
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    standard = {"http": 80, "https": 443}.get(parts.scheme.lower())
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != standard else "") + ")" + quote(tail, safe="%/:?&=,;+@!$'()*[]~")


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w[\w+.-]+:", uri) else (fs.LocalFileSystem(), uri)


# ----------------------------------------------------------------- writing


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit holds the response's head without its payload."""
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    target = quote(url, safe="%/:?&=,;+@!$'()*[]~#") if url else f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head + (payload if refers_to is None else b"")
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name(page_id)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>", f"X-Refers-To-Page-Id: {refers_to}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        out, at = None, 0
        name = f"{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, size, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "refers_to")), strict=True):
                    out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(page_id, url, html or b"", size, digest, refers_to)
                    out.write(data)
                    rows.append((url_key(url or f"urn:page:{page_id}"), page_id, name, at, len(data)))
                    at += len(data)
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every page to ``folder``; the captures: key, page_id, file, offset, length."""
    spark = pages.sparkSession
    store, path = _store(folder)
    store.create_dir(path)
    data = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    facts = shared(rows.select("page_id", "size", "digest").where(F.col("page_id").isNotNull() & (F.col("size") >= LEAST_REVISIT)), "warc-facts")
    first = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = facts.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    # what revisits another leaves its payload behind before the rows are dealt out
    typed = rows.join(again, ["page_id", "digest"], "left")
    typed = typed.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "digest", "refers_to")
    arrow_batches(spark)
    return shared(typed.mapInArrow(_writer(folder), "key string, page_id long, file string, offset long, length long"), "warc-captures")


# ----------------------------------------------------------------- the index


@dataclass
class CaptureIndex:
    """Folder of the blocks, the sparse directory (a table), and the bounds of its parts."""

    folder: str
    directory: DataFrame
    bounds: list[tuple[int, str, str]]


def _packer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name = f"{uuid.uuid4().hex}.cdx.gz"
        out, at, lines, blocks = None, 0, [], []

        def flush() -> None:
            nonlocal at, out
            out = out or store.open_output_stream(f"{path}/{name}", compression=None)
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = pack.compress("".join("\t".join(map(str, x)) + "\n" for x in lines).encode()) + pack.flush()
            out.write(data)
            blocks.append((lines[0][0], lines[-1][0], name, at, len(data), len(lines)))
            at += len(data)
            lines.clear()

        part = None
        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length", "part")), strict=True):
                    part = row[5]
                    lines.append(tuple("" if v is None else v for v in row[:5]))
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
        finally:
            if out:
                out.close()
        cols = list(zip(*blocks, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int64()), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], ["part", "block", "first_key", "last_key", "file", "offset", "length", "lines"])

    return run


def build_index(captures: DataFrame, folder: str) -> CaptureIndex:
    """Sort ``captures`` by key, write them in blocks to ``folder`` and keep the directory of the blocks."""
    spark = captures.sparkSession
    store, path = _store(folder)
    store.create_dir(path)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    order = ("key", "page_id", "file", "offset")  # a hot key is split by what follows
    ranged = captures.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    schema = "part int, block long, first_key string, last_key string, file string, offset long, length long, lines long"
    directory = shared(ranged.mapInArrow(_packer(folder), schema), "warc-directory")
    bounds = directory.groupBy("part").agg(F.min("first_key").alias("a"), F.max("last_key").alias("z")).orderBy("part").collect()  # two keys a part
    return CaptureIndex(folder, directory, [(r["part"], r["a"], r["z"]) for r in bounds])


def lookup(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """The captures (key, page_id, file, offset, length) of every distinct ``key`` in ``keys``."""
    spark = keys.sparkSession
    bounds, folder = index.bounds, index.folder

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [b[1] for b in bounds], [b[2] for b in bounds]
        for batch in batches:
            found = [(bounds[k][0], key) for key in batch.column("key").to_pylist() for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([k for _, k in found], pa.string())], ["part", "key"])

    def of_block(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        firsts, lasts = blocks["first_key"].tolist(), blocks["last_key"].tolist()
        rows = [(k, key) for key in asked["key"] for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
        at = [k for k, _ in rows]
        return pd.DataFrame({"file": blocks["file"].iloc[at].to_numpy(), "offset": blocks["offset"].iloc[at].to_numpy(), "length": blocks["length"].iloc[at].to_numpy(), "key": [k for _, k in rows]})

    def of_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        at, lines, opened, handle = None, {}, None, None
        for batch in batches:
            rows = []
            for file, offset, length, key in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "key")), strict=True):
                if at != (file, offset):
                    if opened != file:
                        handle, opened = store.open_input_file(f"{path}/{file}"), file
                    lines = {}
                    for line in zlib.decompress(handle.read_at(length, offset), 31).decode().splitlines():
                        own = line.split("\t")
                        lines.setdefault(own[0], []).append(own)
                    at = (file, offset)
                rows += [(k, int(p) if p else None, f, int(o), int(n)) for k, p, f, o, n in lines.get(key, ())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["key", "page_id", "file", "offset", "length"])

    asked = keys.select("key").where("key IS NOT NULL").distinct().mapInArrow(of_part, "part int, key string")
    near = index.directory.select("part", "block", "first_key", "last_key", "file", "offset", "length")
    blocks = asked.groupBy("part").cogroup(near.groupBy("part")).applyInPandas(of_block, "file string, offset long, length long, key string")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    dealt = blocks.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(of_line, "key string, page_id long, file string, offset long, length long")


# ----------------------------------------------------------------- reading


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of one record."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def read_records(captures: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of every capture, read by its byte range.

    A response's size and digest are those of the payload read; they must agree with the record's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        opened, handle = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if opened != file:
                    handle, opened = store.open_input_file(f"{path}/{file}"), file
                fields, http, payload = parse(handle.read_at(length, offset))
                said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
                    raise ValueError(f"record at {file}:{offset} does not hold the payload it names")
                number = lambda name, fields=fields: int(fields[name]) if name in fields else None
                rows.append((number("X-Page-Id"), fields["WARC-Target-URI"], size, said, fields["WARC-Type"], number("X-Refers-To-Page-Id")) + ((payload,) if payloads else ()))
            cols = list(zip(*rows, strict=True)) or [()] * (6 + payloads)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 6 + payloads])

    arrow_batches(captures.sparkSession)
    # ranges of places in the archives: every task reads on, and a large archive is split
    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    dealt = captures.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def archived(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write ``pages``, index them, and read every record back by looking its url up."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    captures = write_archives(pages, f"{folder}/archive")
    index = build_index(captures, f"{folder}/index")
    found = shared(lookup(index, captures.select("key")), "warc-found")
    return read_records(found, f"{folder}/archive", payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).drop("url")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
d AS (SELECT page_id, octet_length(data)::BIGINT AS n, sha256(data) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
