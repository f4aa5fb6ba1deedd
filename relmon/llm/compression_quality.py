"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from text labelled good and one
from text labelled bad.  A text is compressed with either in pieces of a fixed
size (all pieces, so the whole text); the difference of the two compressed
sizes, divided by the size of the text, is the only feature, and a logistic
curve fitted on other labelled rows turns it into a calibrated score.

Fitting reads bounded samples: ``DICT_DOCS`` documents of each label (all their
pieces) for the dictionaries, ``CALIBRATION_DOCS`` others
for the curve, always those whose hashed ids are smallest.  What the driver
gets is two dictionaries and that many pairs of numbers.  Every document is
scored, in Arrow batches next to the data; nothing is shuffled for it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import stage, whole_text

DICT_DOCS = 1500
CALIBRATION_DOCS = 4000
PIECE = 2048
DICT_BYTES = 112_640
LEVEL = 3
RIDGE = 1e-3


def split(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE] for i in range(0, len(text), PIECE)]


def train(samples: list[bytes]) -> bytes:
    """A dictionary; of too few samples for training, the samples themselves."""
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, total // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


class Feature:
    """Difference of the compressed sizes (bad minus good) a byte of text."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = map(self._compressor, (good, bad))

    @staticmethod
    def _compressor(content: bytes):
        extra = {}
        if len(content) >= 8:
            extra["dict_data"] = d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False,
                                        write_dict_id=False, **extra)

    def of(self, text: bytes) -> float:
        if not text:
            return 0.0
        pieces = split(text)
        good = sum([len(self.good.compress(p)) for p in pieces])
        bad = sum([len(self.bad.compress(p)) for p in pieces])
        return (bad - good) / len(text)


def logistic(pairs: list[tuple[float, int]]) -> tuple[float, float]:
    """(slope, offset) of P(good | feature), by Newton's method with a small
    ridge; without both labels, the slope is 0 and the offset the smoothed odds."""
    n, good = len(pairs), sum(y for _, y in pairs)
    offset = math.log((good + 1) / (n - good + 1))
    if not 0 < good < n:
        return 0.0, offset
    scale = max(1e-9, math.sqrt(sum(x * x for x, _ in pairs) / n))
    a = 0.0
    b = offset
    for _ in range(100):
        ga, gb, haa, hab, hbb = RIDGE * a, 0.0, RIDGE, 0.0, 1e-9
        for x, y in pairs:
            x /= scale
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            w = p * (1 - p) / n
            ga += (p - y) * x / n
            gb += (p - y) / n
            haa += w * x * x
            hab += w * x
            hbb += w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return a / scale, b


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _samples(labels: DataFrame, dict_docs: int, calibration_docs: int) -> DataFrame:
    """(doc_id, label, part): part is the label for dictionary rows, else
    'cal'.  At most 2 * dict_docs + calibration_docs rows."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~_held_out()) \
                  .groupBy("doc_id").agg(F.min("quality").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    good = known.filter("label = 1").orderBy(*order).limit(dict_docs).withColumn("part", F.lit("good"))
    bad = known.filter("label = 0").orderBy(*order).limit(dict_docs).withColumn("part", F.lit("bad"))
    # half of the ids, by another hash, are left to the curve
    side = F.xxhash64(F.lit("cal"), F.col("doc_id")).bitwiseAND(F.lit(1)) == 1
    cal = known.filter(side).orderBy(*order).limit(calibration_docs).withColumn("part", F.lit("cal"))
    fit = good.unionByName(bad).filter(~side)
    return fit.unionByName(cal)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        dict_docs: int = DICT_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> tuple[bytes, bytes, float, float]:
    """Both dictionaries and the curve.  Held-out rows are never read."""
    picks = stage(_samples(labels, 2 * dict_docs, calibration_docs), "picks")   # bounded, so it can be broadcast
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("t"))
    rows = stage(rows.join(F.broadcast(picks), F.col("id") == F.col("doc_id")).select("doc_id", "label", "part", "t"),
                 "labelled")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, part, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                out += [{"part": part, "doc_id": str(i), "n": n, "p": p} for n, p in enumerate(split(t))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.string()), ("doc_id", pa.string()),
                                                             ("n", pa.int32()), ("p", pa.binary())]))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(r["part"], r["doc_id"], r["n"], r["p"]) for b in batches for r in b.to_pylist()})
        dicts = [train([r[3] for r in got if r[0] == part]) for part in ("good", "bad")]
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.binary()) for d in dicts], names=["good", "bad"])

    small = rows.filter("part <> 'cal'").select("doc_id", "part", "t") \
                .mapInArrow(pieces, "part string, doc_id string, n int, p binary")
    model = small.repartition(1).mapInArrow(learn, "good binary, bad binary").first()
    good, bad = (bytes(model["good"]), bytes(model["bad"])) if model else (b"", b"")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feature(good, bad)
        for b in batches:
            x = [f.of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64())], names=["label", "x"])

    pairs = rows.filter("part = 'cal'").select("label", "t").mapInArrow(features, "label int, x double") \
                .orderBy("x", "label").collect()        # at most calibration_docs rows
    return good, bad, *logistic([(r["x"], r["label"]) for r in pairs])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null or empty text has feature 0 and gets the score of that feature; a
    null doc_id counts as the text '' for the held-out rule; repeated rows get
    equal scores; an empty table gives no rows; without usable labels the
    dictionaries are empty and every score is 0.5.  Other columns are not read.
    """
    good, bad, slope, offset = fit(docs, labels, id_col, text_col, **sizes)
    model = docs.sparkSession.sparkContext.broadcast((good, bad, slope, offset))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, w, a, c = model.value
        f = Feature(g, w)
        for b in batches:
            s = [1 / (1 + math.exp(-max(-700.0, min(700.0, a * f.of(t.as_py()) + c)))) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())],
                                             names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("t"))
    return (rows.select("doc_id", _held_out().alias("held_out"), "t")
                .mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
                .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
