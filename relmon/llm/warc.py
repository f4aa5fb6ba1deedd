"""WARC archives: a writer with revisit records and a splittable reader.

Every record is one gzip member, so an archive can be cut at any byte.  The
reader turns files into byte ranges; a task scans its range for the gzip magic,
takes a candidate for a member only if it decodes to a whole WARC header, the
announced length and a right checksum, and owns the records that start inside
its range (the last one is read beyond it).  Bodies are decoded in blocks into
a digest, so a record of any length takes bounded memory unless payloads are
asked for.

A payload may hold another archive.  Its members decode too, but they lie inside
a member of the file itself: within a range they are jumped over, and what a
later range takes for records inside a member that began before it is dropped
by comparing each range's offsets with how far the ranges before it reached.

Which page of equal payloads is the response is decided on narrow rows; the html
moves once at most, to meet that decision by id and digest.  Files carry a name
of the task's attempt, and the manifest that Spark's own committer writes says
which of them count, so a task that is lost and run again leaves no record twice.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmon.llm.common import stage
from relmon.session import scratch_path

MIN_REVISIT = 100               # payloads of fewer bytes are always written whole
FILE_BYTES = 1 << 30            # a task starts its next file beyond so many bytes
SPLIT_BYTES = 32 << 20          # bytes of a reader's range
BLOCK = 1 << 18                 # bytes read or decoded at a time
MAX_HEADER = 1 << 20            # a longer header is none

# The format's magic, version line, record types and field names.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

MANIFEST = "path string, length long, records long"
RECORD = ("path string, range_start long, offset long, member_end long, warc_type string, record_id string, target_uri string, "
          "page_id string, refers_to string, refers_to_page string, payload_bytes long, payload_digest string, payload binary")


# ---------------------------------------------------------------- writing

def _payload(col: str = "html") -> Column:
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, first_id) of the pages whose payload of at least
    ``least`` bytes equals that of a page with a smaller id.  Only ids and
    32-byte digests move; copies are counted on the map side first, and the
    join's large side (one hot payload) is one that Spark can split."""
    p = _payload(html_col)
    tab = stage(pages.select(F.col(id_col).alias("id"), F.unhex(F.sha2(p, 256)).alias("digest"), F.octet_length(p).alias("n"))
                     .filter(F.col("n") >= least).drop("n"), "payloads")
    first = tab.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (tab.join(first.select("digest", "first_id"), "digest")
               .filter(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")))
               .groupBy("id", "digest").agg(F.first("first_id").alias("first_id")))


def _record_id(page: str, digest: str) -> str:
    """The same page and payload always give the same id, so a revisit can name its response."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page}\n{digest}'.encode()).digest()[:16], version=4)}>"


def _record(fields: list[tuple[str, str]], *blocks: bytes) -> Iterator[bytes]:
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"Content-Length: {sum(map(len, blocks))}".encode(), b"", b""]
    yield b"\r\n".join(head)
    yield from blocks
    yield b"\r\n\r\n"


def page_record(page: str | None, url: str | None, payload: bytes, first: str | None, date: str) -> Iterator[bytes]:
    """A response record, or a revisit of page ``first``, in pieces."""
    digest = hashlib.sha256(payload).hexdigest()
    own = "" if page is None else page
    fields = [("WARC-Type", RESPONSE if first is None else REVISIT), ("WARC-Record-ID", _record_id(own, digest)),
              ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-X-Payload-Length", str(len(payload)))]
    if page is not None:
        fields.append(("WARC-X-Page-ID", page))
    if url:
        # line ends and other control characters can't stand in a header field
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if first is not None:
        fields += [("WARC-Refers-To", _record_id(first, digest)), ("WARC-X-Refers-To-Page-ID", first), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, http, *([payload] if first is None else []))


class _Archive:
    """One file of gzip members."""

    def __init__(self, base: str, name: str, level: int, date: str):
        self.fs, root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(root, recursive=True)
        self.path, self.level, self.length, self.records = f"{base.rstrip('/')}/{name}", level, 0, 0
        self.out = self.fs.open_output_stream(f"{root.rstrip("/")}/{name}", compression=None)   # the members are compressed here
        info = b"software: relmon\r\nformat: WARC File Format 1.1\r\n"
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name, "")), ("WARC-Date", date),
                          ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
        self.records = 0

    def add(self, pieces: Iterator[bytes]) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        for p in pieces:
            for at in range(0, len(p), BLOCK):
                self._put(z.compress(p[at:at + BLOCK]))
        self._put(z.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.length += len(data)

    def close(self) -> tuple:
        self.out.close()
        return self.path, self.length, self.records


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _writer(base: str, level: int, date: str, file_bytes: int):
    schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        now, done = None, []
        for b in batches:
            for page, url, html, first in zip(*(b.column(i) for i in range(4))):
                if now is None:
                    now = _Archive(base, f"{name}-{len(done):04d}.warc.gz", level, date)
                html = html.as_buffer()
                now.add(page_record(page.as_py(), url.as_py(), html.to_pybytes() if html is not None else b"", first.as_py(), date))
                if now.length >= file_bytes:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        yield _batch(done, schema)
    return write


def write_warc(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               least: int = MIN_REVISIT, level: int = 6, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per page; returns the manifest (path, length, records).

    Of pages with equal payloads of at least ``least`` bytes the one with the
    smallest id becomes a response, the others revisit it.  A null html is an
    empty payload; a null id is no smallest one (a group of null ids only is all
    responses); rows that repeat id and payload at the smallest id are all
    responses; a null url is left out.  An empty table writes no file.  Only the
    three named columns are read.  ``path`` (default: a new folder under the
    checkpoint folder) is a URI of a file system that all executors share and
    that pyarrow opens (file, hdfs, s3, gs ...)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, f"warc-{uuid.uuid4().hex[:12]}")
    path = path if "://" in path or path.startswith("file:") else "file://" + path
    path = re.sub(r"^file:/+", "file:///", path)
    again = revisits(pages, id_col, html_col, least).select(
        F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("first_id").alias("__first"))
    p = _payload(html_col)
    # hashed again beside the html: a page meets its decision by id and digest, so copies of a payload are no hot key
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), p.alias("html"), F.unhex(F.sha2(p, 256)).alias("digest"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    rows = rows.select(F.col("id").cast("string").alias("id"), F.col("url").cast("string").alias("url"), "html",
                       F.col("__first").cast("string").alias("first"))
    return stage(rows.mapInArrow(_writer(path, level, date, file_bytes), MANIFEST), "warc-manifest")


# ---------------------------------------------------------------- reading

def _next_magic(f, at: int, end: int) -> int | None:
    """Offset of the first gzip magic in [at, end)."""
    while at < end:
        f.seek(at)
        data = f.read(BLOCK + len(MAGIC) - 1)
        k = data.find(MAGIC)
        if k >= 0:
            return at + k if at + k < end else None
        if len(data) < BLOCK + len(MAGIC) - 1:
            return None
        at += BLOCK
    return None


class _Member:
    """The gzip member at an offset, decoded block by block.  ``end`` is known
    when it is over; one that is damaged, cut or none at all raises ``zlib.error``."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.f, self.pos, self.z, self.rest, self.end = f, at, zlib.decompressobj(31), b"", None

    def next(self) -> bytes:
        """The next decoded block, empty at the end."""
        while not self.z.eof:
            data = self.rest or self.f.read(BLOCK)
            if not data:
                raise zlib.error("cut")
            if not self.rest:
                self.pos += len(data)
            out = self.z.decompress(data, BLOCK)
            self.rest = self.z.unconsumed_tail
            if out:
                return out
        self.end = self.pos - len(self.z.unused_data)
        return b""


def _upto_empty_line(m: _Member, buf: bytes, start: bytes = b"", limit: int = MAX_HEADER) -> tuple[int, bytes]:
    """Where the empty line behind a header begins (-1: none, or another start) and what was decoded so far."""
    while True:
        if not (buf.startswith(start) or start.startswith(buf)):
            return -1, buf
        k = buf.find(b"\r\n\r\n")
        if k >= 0 or len(buf) > limit:
            return k, buf
        more = m.next()
        if not more:
            return -1, buf
        buf += more


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if sep:
            out[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return out


def read_member(f, at: int, payloads: bool) -> tuple | None:
    """The record of the member at ``at``, or None if there is no whole one:
    (end, fields, payload bytes, payload sha256, payload or None)."""
    try:
        m = _Member(f, at)
        k, buf = _upto_empty_line(m, b"", b"WARC/")
        fields = _fields(buf[:k]) if k >= 0 else {}
        if "warc-type" not in fields or not fields.get("content-length", "").isdigit():
            return None
        left, buf = int(fields["content-length"]), buf[k + 4:]
        if fields.get("content-type", "").startswith("application/http"):
            k, buf = _upto_empty_line(m, buf, limit=min(left, MAX_HEADER))
            if 0 <= k <= left - 4:
                left, buf = left - k - 4, buf[k + 4:]
        n, sha, kept = 0, hashlib.sha256(), [] if payloads else None
        while True:
            own, buf = buf[:left], buf[left:]
            left -= len(own)
            n += len(own)
            sha.update(own)
            if payloads:
                kept.append(own)
            more = m.next() if len(buf) <= 4 else b""
            if not more:
                break
            buf += more
        if left or buf != b"\r\n\r\n" or m.end is None:
            return None
    except zlib.error:
        return None
    return m.end, fields, n, sha.hexdigest(), b"".join(kept) if payloads else None


def _row(path: str, start: int, at: int, rec: tuple) -> tuple:
    end, f, n, sha, payload = rec
    if f["warc-type"] == REVISIT:
        # the payload itself is in the response: its digest and length as the record states them
        sha = f.get("warc-payload-digest", "").removeprefix("sha256:").lower() or None
        n = int(f["warc-x-payload-length"]) if f.get("warc-x-payload-length", "").isdigit() else None
        payload = None
    return (path, start, at, end, f["warc-type"], f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-x-page-id"),
            f.get("warc-refers-to"), f.get("warc-x-refers-to-page-id"), n, sha, payload)


def scan_range(f, start: int, end: int, payloads: bool = False) -> Iterator[tuple[int, tuple]]:
    """(offset, record) of the records that start in [start, end)."""
    at = _next_magic(f, start, end)
    while at is not None:
        rec = read_member(f, at, payloads)
        if rec is not None:
            yield at, rec
        at = _next_magic(f, rec[0] if rec else at + 1, end)


def _reader(payloads: bool):
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split(" ")[0], types[c.split(" ")[1]]) for c in RECORD.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for r in b.to_pylist():
                files, p = pafs.FileSystem.from_uri(r["path"])
                with files.open_input_file(p) as f:
                    for at, rec in scan_range(f, r["start"], r["end"], payloads):
                        rows.append(_row(r["path"], r["start"], at, rec))
                        held += len(rec[4] or b"")
                        if len(rows) >= 4096 or held >= 32 * BLOCK:
                            yield _batch(rows, schema)
                            rows, held = [], 0
        yield _batch(rows, schema)
    return read


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives under a path, listed by Spark; no content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true") \
                .load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length")


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """All records of the archives listed in ``files`` (path, length), each
    once: columns as in ``RECORD``, payloads only if asked for.  One task for
    each range of ``split_bytes``, wherever the files begin and end.  Damaged,
    cut or foreign members are passed over; an empty list gives no rows."""
    ranges = files.select("path", "length", F.explode(
        F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))
    # as many tasks as ranges: rows this narrow would all be put into one task
    n = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    ranges = ranges.repartition(int(n))
    narrow = stage(ranges.mapInArrow(_reader(False), RECORD), "warc-records")
    return drop_nested(ranges.mapInArrow(_reader(True), RECORD) if payloads else narrow, narrow)


def drop_nested(records: DataFrame, narrow: DataFrame) -> DataFrame:
    """``records`` without those that lie inside a member which began in an earlier
    range of their file, as ``narrow`` (the same records, maybe without payloads)
    tells.  One row per range is ordered; records meet it by range."""
    reach = narrow.groupBy("path", "range_start").agg(F.max("member_end").alias("__reach"))
    w = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    reach = reach.withColumn("__reach", F.max("__reach").over(w)).filter(F.col("__reach") > F.col("range_start"))
    j = records.join(reach, ["path", "range_start"], "left")
    return j.filter(F.col("__reach").isNull() | (F.col("offset") >= F.col("__reach"))).drop("__reach") \
            .select(*[c.split(" ")[0] for c in RECORD.split(", ")])


def page_records(pages: DataFrame, id_col: str = "page_id", **more) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to; one row per row of ``pages``."""
    kind = pages.schema[id_col].dataType
    recs = read_warc(write_warc(pages, id_col=id_col, **more))
    return recs.filter(F.col("warc_type").isin(RESPONSE, REVISIT)).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), F.col("refers_to_page").cast(kind).alias("refers_to"))
