import gzip
import hashlib
import io
import random
import uuid
import zlib

import pyarrow.fs as pafs
import pytest
from llm_helpers import clash
from pyspark.sql import functions as F

from relmon.llm import warc as W
from relmon.session import scratch_path

PAGES = "page_id long, url string, html string"


def member(data):
    z = zlib.compressobj(0, zlib.DEFLATED, 31)      # stored: what it holds stays readable inside
    return z.compress(data) + z.flush()


def archive(n, seed=3):
    rnd = random.Random(seed)
    out, starts = b"", []
    for i in range(n):
        starts.append(len(out))
        body = bytes(rnd.choices(b"abc \n\x1f\x8b\x08", k=rnd.randrange(0, 900)))
        out += gzip.compress(b"".join(W.page_record(str(i), "http://x/", body, None, "d")), 6)
    return out, starts


def test_every_cut_gives_each_record_once():
    data, starts = archive(60)
    f = io.BytesIO(data)
    for split in (1, 7, 64, 500, 1000, 5000, len(data)):
        got = [at for a in range(0, len(data), split) for at, _ in W.scan_range(f, a, min(a + split, len(data)))]
        assert got == starts, split


def test_a_range_reads_no_further_than_its_last_record():
    data, starts = archive(200)

    class Counted(io.BytesIO):
        far = 0

        def read(self, n=-1):
            out = super().read(n)
            self.far = max(self.far, self.tell())
            return out
    f = Counted(data)
    list(W.scan_range(f, 0, starts[10]))
    assert f.far <= starts[10] + 2 * W.BLOCK


def test_damaged_cut_and_foreign_members_are_passed_over():
    data, starts = archive(8)
    whole = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
    bad = bytearray(whole[2])
    bad[-6] ^= 1                                    # checksum
    foreign = gzip.compress(b"no record at all")
    short = member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabc\r\n\r\n")
    lengthless = member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")
    parts = [b"\x1f\x8b\x08junk", whole[0], foreign, whole[1], bytes(bad), short, whole[3], lengthless, whole[4], whole[5][:-20]]
    f = io.BytesIO(b"".join(parts))
    got = [rec[1]["warc-x-page-id"] for _, rec in W.scan_range(f, 0, 1 << 30)]
    assert got == ["0", "1", "3", "4"]


def test_odd_bodies():
    request = W._record([("WARC-Type", "request"), ("Content-Type", "application/http; msgtype=request")], b"GET / HTTP/1.1\r\nHost: x\r\n\r\n")
    bare = W._record([("WARC-Type", "response"), ("Content-Type", "application/http")], b"no header at all")
    long = W.page_record("9", None, b"x" * (3 * W.BLOCK + 17), None, "d")
    f = io.BytesIO(b"".join(member(b"".join(r)) for r in (request, bare, long)))
    got = [(rec[2], rec[4][:5]) for _, rec in W.scan_range(f, 0, 1 << 30, payloads=True)]
    assert got == [(0, b""), (16, b"no he"), (3 * W.BLOCK + 17, b"xxxxx")]


def put(spark, name, data):
    base = "file://" + scratch_path(spark, f"warc-test-{uuid.uuid4().hex[:8]}").removeprefix("file:")
    fs, root = pafs.FileSystem.from_uri(base)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(data)
    return base


def test_archive_inside_a_payload(spark):
    """Stored members inside a payload decode as records of their own: no range may take them for such."""
    inner, _ = archive(30)
    outer = b"".join(member(b"".join(W.page_record(f"o{i}", None, inner, None, "d"))) for i in range(4))
    base = put(spark, "nested.warc.gz", outer)
    files = W.list_files(spark, base)
    assert [r.length for r in files.collect()] == [len(outer)]
    for split in (700, 5000, 1 << 25):
        got = W.read_warc(files, split_bytes=split, payloads=split == 5000).collect()
        assert sorted(r.page_id for r in got) == ["o0", "o1", "o2", "o3"], split
        assert {r.payload_digest for r in got} == {hashlib.sha256(inner).hexdigest()}
        if split == 5000:
            assert {bytes(r.payload) for r in got} == {inner}


def brute(rows, least=100):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in data:
        ids = [j for j, q in data if q == p and j is not None]
        first = min(ids) if ids and len(p) >= least else i
        same = first == i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if same else "revisit", None if same else first))
    return sorted(out, key=str)


ODD = [(1, None, None), (None, "http://x.example/\r\nA: b", "z" * 120), (2, "not a url é\n", ""), (3, "http://x.example/a", "y" * 100),
       (3, "http://x.example/a", "y" * 100), (9, "http://x.example/b", "y" * 100), (8, None, "y" * 99), (7, None, "y" * 99),
       (None, None, "only null ids " * 20), (None, None, "only null ids " * 20), (4, "u", "z" * 120), (5, "u", "long text \U0001f600 " * 60_000),
       (6, "u", "WARC/1.1\r\n\r\n" * 30), (-4, "u", "z" * 120)]


def test_odd_pages_against_brute_force(spark):
    pages = spark.createDataFrame(ODD, PAGES)
    got = W.page_records(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = brute(ODD)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, W.page_records(clash(pages).repartition(5), file_bytes=1000).collect()), key=str) == want
    assert W.page_records(pages.limit(0)).collect() == []


def test_files_are_whole_archives_and_round_trip(spark, sf):
    """Texts come back from the files; many files, each a plain gzip of records; revisits name a response that is there."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("n", F.lit(1))
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1_000_000)).repartition(3)
    files = W.write_warc(twice, file_bytes=20_000)
    paths = [r.path for r in files.collect()]
    assert len(paths) > 3
    fs, p = pafs.FileSystem.from_uri(paths[0])
    with fs.open_input_file(p) as f:
        raw = f.read()
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    recs = W.read_warc(files, split_bytes=3000, payloads=True).collect()
    ids = {r.record_id for r in recs if r.warc_type == "response"}
    back = {int(r.page_id): r.payload.decode() for r in recs if r.warc_type == "response"}
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(html[i] == t for i, t in back.items())
    again = [r for r in recs if r.warc_type == "revisit"]
    assert len(again) >= len(html) and all(r.refers_to in ids for r in again)
    assert sum(r.records for r in files.collect()) == 2 * len(html)
    # folder listing reads the same files
    listed = W.list_files(spark, paths[0].rsplit("/", 1)[0])
    assert sorted(r.path for r in listed.collect()) == sorted(paths)


def test_files_of_lost_attempts_do_not_count(spark):
    """A file that no manifest row names (its task was lost) is not read."""
    pages = spark.createDataFrame(ODD, PAGES)
    files = W.write_warc(pages)
    path = files.first().path
    fs, p = pafs.FileSystem.from_uri(path)
    fs.copy_file(p, p.replace("part-", "part-lost-"))
    assert W.read_warc(files).filter("warc_type <> 'warcinfo'").count() == len(ODD)
