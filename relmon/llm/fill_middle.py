"""Fill-in-the-middle transformation by secondary sort.

A document is cut into lines, and at two places drawn from its id into prefix,
middle and suffix.  Their chunks of whole lines are emitted as pieces keyed by
document and output position.  One shuffle by document and a sort by position
within the partitions (the DataFrame form of repartitionAndSortWithinPartitions:
sorted in the JVM, spilling to disk) let each task read the pieces of a document
in the order of its output, one after another, into an incremental digest or
a text.  Restoration reads that output piece by piece, finds the sentinels, and
emits what stands behind them keyed by its place in the text; the rows
are where they have to be already, so a second sort within the partitions, and
no shuffle, gives the text back.

No task holds a document as a whole but the one that cuts it, which gets it as
one value of its row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 14             # code points of a piece at most
SPM_PERCENT = 50            # share of the suffix-first form
FIM_PERCENT = 100           # share of documents that are transformed
SEED = "7"
BATCH_BYTES = 4 << 20

# The sentinels and the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Where the part behind a sentinel stands in the text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
KEY = ["doc_id", "key", "task"]


def line_count(text: str) -> int:
    return text.count("\n") + (bool(text) and not text.endswith("\n"))


def _after_lines(text: str, k: int, n: int) -> int:
    """Offset behind the first k of n lines."""
    if k >= n:
        return len(text)
    at = 0
    for _ in range(k):
        at = text.index("\n", at) + 1
    return at


def plan(doc_id, text: str, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: str = SEED) -> tuple[str, int, int, int]:
    """(form, lines, end of the prefix, end of the middle) of a text; the draws
    depend on the id alone (a null id draws as an empty one)."""
    n = line_count(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= fim_percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, n, 0, 0
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    return SPM if h4 % 100 < spm_percent else PSM, n, _after_lines(text, lo, n), _after_lines(text, hi, n)


def _chunks(text: str, start: int, end: int, size: int) -> Iterator[str]:
    """text[start:end] in pieces of whole lines; one longer than ``size`` is cut."""
    while end - start > size:
        at = text.rfind("\n", start, start + size) + 1 or start + size
        yield text[start:at]
        start = at
    yield text[start:end]


def output_pieces(text: str, form: str, a: int, b: int, size: int = CHUNK) -> Iterator[str]:
    """The output in order; a sentinel stands at the begin of its piece."""
    if form == PLAIN:
        yield from _chunks(text, 0, len(text), size)
        return
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX, MIDDLE):
        for i, piece in enumerate(_chunks(text, *parts[mark], size)):
            yield mark + piece if i == 0 else piece


class _Out:
    """Record batches of bounded size from rows."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size + 64
        if self.held > BATCH_BYTES:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def _schemas(kind: str, arrow: pa.DataType, *fields: tuple[str, str]) -> tuple[str, pa.Schema]:
    """DDL and Arrow schema: the document's key, then ``fields``."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    ddl = ", ".join([f"doc_id {kind}", "key binary", "task int", *(f"{n} {t}" for n, t in fields)])
    return ddl, pa.schema([("doc_id", arrow), ("key", pa.binary()), ("task", pa.int32()), *((n, types[t]) for n, t in fields)])


ABOUT = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long")]


def _cut(schema: pa.Schema, options: dict, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get().partitionId(), _Out(schema)
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                doc_id, text = doc_id.as_py(), text.as_py()
                form, n, lo, hi = plan(doc_id, text, **options)
                about = (n, form, *((None, None) if form == PLAIN else (lo, hi - lo)))
                key = (doc_id, xxhash.xxh3_128_digest(text.encode()), task)
                for pos, piece in enumerate(output_pieces(text, form, lo, hi, size)):
                    # what is said of the document goes with its first piece
                    yield from out.add((*key, pos, piece, *(about if pos == 0 else (None,) * 4)), len(piece))
        yield out.flush()
    return cut


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, **options) -> DataFrame:
    """Pieces in the order of the output: document key, position, piece, and with
    position 0 what ``plan`` says.  The key is the id, a 128-bit hash of the text
    and the number of the task that cut it: rows that repeat id and text in one
    task are equal pieces side by side, those of other tasks stay apart."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ddl, schema = _schemas(src.schema["doc_id"].dataType.simpleString(), _arrow_type(src), ("pos", "int"), ("piece", "string"), *ABOUT)
    return src.mapInArrow(_cut(schema, options, chunk), ddl)


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema["doc_id"].dataType)


def in_output_order(cut: DataFrame) -> DataFrame:
    """Documents together, pieces in order of the output: one shuffle, one sort."""
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "pos")


def _grouped(batches: Iterator[pa.RecordBatch], position: int, start: Callable, step: Callable, stop: Callable) -> Iterator[pa.RecordBatch]:
    """Runs start(key, row), step(key, state, row), stop(key, state, copies) over
    rows sorted by the three key columns and the position columns up to
    ``position``; equal rows (copies of a document) are stepped through once and counted."""
    key, state, copies, last, first = None, None, 0, None, None
    for row in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
        if row[:3] != key:
            if key is not None:
                yield from stop(key, state, copies)
            key, first, last, copies = row[:3], row[3:position], row[3:position], 1
            state = start(key, row)
        elif row[3:position] == last:
            copies += last == first
            continue
        last = row[3:position]
        yield from step(key, state, row)
    if key is not None:
        yield from stop(key, state, copies)


def _digest_and_restore(schema: pa.Schema):
    """Reads outputs; emits for each a row with its digest (place -1), then the
    pieces behind each sentinel with their place in the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)

        def start(key, row):
            return {"sha": hashlib.sha256(), "about": row[5:9], "place": 0, "seq": 0}

        def step(key, st, row):
            piece = row[4]
            st["sha"].update(piece.encode())
            if st["about"][1] != PLAIN and piece[:3] in PLACE:
                st["place"], st["seq"], piece = PLACE[piece[:3]], 0, piece[3:]
            yield from out.add((*key, st["place"], st["seq"], piece, None, *(None,) * 4, None), len(piece))
            st["seq"] += 1

        def stop(key, st, copies):
            yield from out.add((*key, -1, 0, None, st["sha"].hexdigest(), *st["about"], copies))
        yield from _grouped(batches, 4, start, step, stop)
        yield out.flush()
    return run


def _digest_restored(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)

        def start(key, row):
            return {"sha": hashlib.sha256(), "head": row[6:12]}

        def step(key, st, row):
            if row[5] is not None:
                st["sha"].update(row[5].encode())
            return ()

        def stop(key, st, copies):
            output, n, form, prefix, middle, copies = st["head"]
            for _ in range(copies):
                yield from out.add((key[0], n, form, prefix, middle, output, st["sha"].hexdigest()), 256)
        yield from _grouped(batches, 5, start, step, stop)
        yield out.flush()
    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars,
    output_sha256, restored_sha256.

    A null text is empty (form plain, no lines); a null id draws as an empty
    one; rows that repeat an id, or id and text, are documents of their own; an
    empty table gives no rows.  Other columns are not read, whatever their names."""
    cut = pieces(docs, id_col, text_col, chunk, **options)
    kind, arrow = cut.schema["doc_id"].dataType.simpleString(), _arrow_type(cut)
    ddl, schema = _schemas(kind, arrow, ("place", "int"), ("seq", "int"), ("piece", "string"), ("output", "string"), *ABOUT, ("copies", "long"))
    outputs = in_output_order(cut).mapInArrow(_digest_and_restore(schema), ddl)
    types = {"long": pa.int64(), "string": pa.string()}
    last = [*ABOUT, ("output_sha256", "string"), ("restored_sha256", "string")]
    done = pa.schema([("doc_id", arrow), *((n, types[t]) for n, t in last)])
    # still the partitions of the shuffle: sorting them again is enough
    return outputs.sortWithinPartitions(*KEY, "place", "seq").mapInArrow(
        _digest_restored(done), ", ".join([f"doc_id {kind}", *(f"{n} {t}" for n, t in last)]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, **options) -> DataFrame:
    """doc_id, form, output of every row: the same sorted pieces, joined to
    texts (one output in memory at a time).  Nulls and repeated rows as in ``digests``."""
    cut = pieces(docs, id_col, text_col, chunk, **options)
    kind, arrow = cut.schema["doc_id"].dataType.simpleString(), _arrow_type(cut)
    schema = pa.schema([("doc_id", arrow), ("form", pa.string()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)

        def step(key, st, row):
            st[1].append(row[4])
            return ()

        def stop(key, st, copies):
            text = "".join(st[1])
            for _ in range(copies):
                yield from out.add((key[0], st[0], text), len(text))
        yield from _grouped(batches, 4, lambda key, row: (row[6], []), step, stop)
        yield out.flush()
    return in_output_order(cut).mapInArrow(run, f"doc_id {kind}, form string, output string")


def restore(output: str, form: str) -> str:
    """The text of one output."""
    if form == PLAIN:
        return output
    head, tail = output.split(MIDDLE, 1)
    first, second = head[3:].split(SUFFIX if form == PSM else PREFIX, 1)
    return first + tail + second if form == PSM else second + tail + first
