"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most three of their 64 bits are linked.  Two
disjoint parts of 31 bits are looked at: of three differing bits, at most one
lies in one of the parts.  Over each part the perfect Hamming code of length
31 is a covering code: every 31-bit word is within the covering radius 1 of
exactly one code word, its home anchor.  If two words differ in at most one
bit, the home anchor of the first is within 1 + 1 = 2 (covering radius plus
the threshold of the part) of the second.  So each fingerprint is replicated
to every anchor within 2 of its part (one to sixteen of 2^26), and at each
anchor the fingerprints at home are compared with all that were sent there,
over all 64 bits.  No link is lost; a pair meets at a few anchors only.

Work is done on distinct fingerprints, so any number of copies is one vertex.
At an anchor only a spanning forest of the links found is kept, so rows stay
in proportion to the vertices even where all fingerprints of a group link.
Anchors with many fingerprints are split into a grid of cells of a fixed size:
those at home are dealt over its rows, all that come there over its columns, and each
pair meets in one cell.
Components are found by alternating star contraction, each round a written
table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import stage, whole_text
from relmon.llm.exact_dedup import keep_rows

SHINGLE = 3
MAX_BITS = 3
SEED = 42
PART = 31                 # length of the Hamming code: positions 1..31
CELL_HOMES = 4096         # of an anchor with more fingerprints, a cell holds about so many at home
CELL_ROWS = 1 << 15       # and about so many in all
COUNTERS = 2048           # fingerprints that may hold more than 1/2048 of the rows are joined on the map side
SMALL_RUN = 4096          # comparisons of a run that are done in one vector step
_PIECE = 1 << 15


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash.  bytes.lower() touches A-Z only and
    bytes.split() cuts at [\\x20\\x09-\\x0D]+, as the contract says."""
    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    hash64, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, _PIECE):
        upto = min(n, at + _PIECE)
        h = np.array([hash64(join(w[i:i + shingle]), SEED) for i in range(at, upto)], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << j for j in np.flatnonzero(ones * 2 > n).tolist())


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "th", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (hash of the text) and fp (the fingerprint's 64 bits as a
    signed long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = whole_text(text_col)
    raw = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("t"))
    return raw.mapInArrow(_fingerprint_batches(shingle), f"doc_id {kind}, th long, fp long")


# ---------------------------------------------------------------- anchors

def _part(fp: Column, part: int) -> Column:
    return F.shiftrightunsigned(fp, PART * part).bitwiseAND(F.lit((1 << PART) - 1))


def _syndrome(x: Column) -> Column:
    """XOR of the positions (1..31) of the set bits; 0 for a code word."""
    s = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, PART + 1) if p >> j & 1)
        s = s + F.shiftleft(F.bit_count(x.bitwiseAND(F.lit(mask))) % 2, j)
    return s.cast("int")


def anchors(classes: DataFrame) -> DataFrame:
    """(key, fp, home): a row for every anchor a distinct fingerprint goes to.
    key holds the part and the code word."""
    bit = lambda p: F.shiftleft(F.lit(1).cast("long"), (p - F.lit(1)).cast("int"))
    out = None
    for part in (0, 1):
        d = classes.select("fp", _part(F.col("fp"), part).alias("x")).withColumn("s", _syndrome(F.col("x")))
        home = F.when(F.col("s") == 0, F.col("x")).otherwise(
            F.col("x").bitwiseXOR(F.expr("shiftleft(1L, greatest(s, 1) - 1)")))
        far = F.expr("""CASE WHEN s = 0 THEN array() ELSE
            transform(filter(sequence(1, 31), p -> p < (s ^ p)),
                      p -> x ^ shiftleft(1L, p - 1) ^ shiftleft(1L, (s ^ p) - 1)) END""")
        rows = d.select("fp", F.explode(F.concat(
            F.array(F.struct(home.alias("a"), F.lit(True).alias("home"))),
            F.transform(far, lambda a: F.struct(a.alias("a"), F.lit(False).alias("home"))))).alias("v"))
        rows = rows.select((F.col("v.a") + F.lit(part << PART)).alias("key"), "fp", F.col("v.home").alias("home"))
        out = rows if out is None else out.unionByName(rows)
    return out


def salted(rows: DataFrame) -> DataFrame:
    """(key, salt, fp, home): anchors cut into cells.  A fingerprint at home is in all
    cells of its row, as one that the others are compared with, and like every
    fingerprint of the anchor in all cells of its column.  An anchor of up to
    ``CELL_HOMES`` at home and ``CELL_ROWS`` in all is one cell."""
    size = rows.groupBy("key").agg(F.count(F.when(F.col("home"), 1)).alias("h"), F.count(F.lit(1)).alias("v"))
    hot = size.filter((F.col("h") > CELL_HOMES) | ((F.col("v") > CELL_ROWS) & (F.col("h") > 0))).select(
        "key", F.ceil(F.col("h") / CELL_HOMES).cast("int").alias("nh"), F.ceil(F.col("v") / CELL_ROWS).cast("int").alias("nv"))
    nh, nv = F.coalesce("nh", F.lit(1)), F.coalesce("nv", F.lit(1))
    i, j = F.pmod(F.xxhash64("fp"), nh).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), nv).cast("int")
    column = F.transform(F.sequence(F.lit(0), nh - 1), lambda r: F.struct(
        (r * nv + j).alias("salt"), (F.col("home") & (r == i)).alias("home")))
    # the rest of a home's row; where its column crosses it, it is there already
    row = F.transform(F.filter(F.sequence(F.lit(0), nv - 1), lambda c: F.col("home") & (c != j)),
                      lambda c: F.struct((i * nv + c).alias("salt"), F.lit(True).alias("home")))
    return rows.join(hot, "key", "left").select("key", "fp", F.explode(F.concat(column, row)).alias("c")) \
               .select("key", F.col("c.salt").alias("salt"), "fp", F.col("c.home").alias("home"))


# ---------------------------------------------------------------- links at an anchor

class _Forest:
    """Union-find that says whether a link joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        r = a
        while up.setdefault(r, r) != r:
            r = up[r]
        while up[a] != r:
            up[a], a = r, up[a]
        return r

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _large_run(fp: np.ndarray, home: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links home-visitor of one run, a home at a time."""
    label = np.arange(len(fp))
    bits = fp.view(np.uint64)           # numpy counts the bits of a signed number's absolute value
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(home):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= limit)
        labels, first = np.unique(label[near], return_index=True)
        other = labels != label[i]
        if other.any():
            out += [(int(fp[i]), int(fp[j])) for j in near[first[other]]]
            label[np.isin(label, labels)] = label[i]
    return out


def _runs(key, fp, home, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of whole runs of equal keys."""
    n = len(key)
    starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
    lens = np.diff(np.r_[starts, n])
    homes = np.add.reduceat(home.astype(np.int64), starts)
    size = homes * lens
    forest, out = _Forest(), []
    small = (homes > 0) & (lens > 1) & (size <= SMALL_RUN)
    run_of = np.repeat(np.arange(len(starts)), lens)
    at = np.flatnonzero(home & small[run_of])
    # pairs of a few million at once
    width = lens[run_of[at]]
    cuts = np.searchsorted(np.cumsum(width), np.arange(1 << 21, int(width.sum()) + (1 << 21), 1 << 21))
    for piece in np.split(at, np.minimum(cuts + 1, len(at))):
        if not len(piece):
            continue
        r = run_of[piece]
        left = np.repeat(piece, lens[r])
        offset = np.arange(len(left)) - np.repeat(np.cumsum(lens[r]) - lens[r], lens[r])
        right = np.repeat(starts[r], lens[r]) + offset
        bits = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64))
        hit = (bits > 0) & (bits <= limit)
        for a, b in zip(fp[left[hit]].tolist(), fp[right[hit]].tolist()):
            if forest.join(a, b):
                out.append((a, b))
    for r in np.flatnonzero((homes > 0) & (size > SMALL_RUN)):
        s = slice(starts[r], starts[r] + lens[r])
        out += [x for x in _large_run(fp[s], home[s], limit) if forest.join(*x)]
    return out


def _link_batches(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(parts):
            key, fp, home = (np.concatenate(x) for x in zip(*parts))
            links = np.array(_runs(key, fp, home, limit), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

        held: list[tuple] = []      # whole runs, and the last run as far as it came
        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            # key and salt in one number: equal neighbours are equal in both
            key = b.column(0).to_numpy() * np.int64(1 << 30) + b.column(1).to_numpy()
            fp, home = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            held_key = held[-1][0][-1] if held else None
            cut = int(change[-1]) if len(change) else (0 if held_key is not None and held_key != key[0] else None)
            if cut is not None and rows + cut >= 1 << 18:
                yield found([*held, (key[:cut], fp[:cut], home[:cut])])
                held, rows = [(key[cut:], fp[cut:], home[cut:])], len(key) - cut
            else:
                held.append((key, fp, home))
                rows += len(key)
        if held:
            yield found(held)
    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints; their transitive closure is
    that of all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two parts with covering radius 1 find links of at most three bits")
    rows = salted(anchors(classes))
    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.mapInArrow(_link_batches(max_bits), "a long, b long")


# ---------------------------------------------------------------- components

def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v), u > v.  Large: every larger neighbour of a
    vertex moves to the smallest vertex of its neighbourhood.  Small: the
    smaller neighbours do, and the vertex itself.  The minimum is an aggregate
    with map-side combining, joined back, so a vertex with very many
    neighbours is not gathered in one place."""
    if large:
        e = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges
    low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    j = e.join(low, "u")
    if large:
        out = j.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(fp, root) for every vertex that occurs in ``pairs`` (a, b); root is the
    smallest vertex that can be reached."""
    edges = stage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                       .filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        edges = stage(_star(_star(edges, True), False), "stars")
    roots = edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(roots)


def _of_fingerprints(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint."""
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = stage(components(links(classes.select("fp"), max_bits)), "roots")
    smallest = roots.join(classes, "fp").groupBy("root").agg(F.min("rep").alias("cid"))
    linked = roots.join(smallest, "root").select("fp", "root", "cid")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"),
                                                     F.coalesce("cid", "rep").alias("component_id"))


def _of_rows(fps: DataFrame, of: DataFrame) -> DataFrame:
    """Every row with what ``of`` says of its fingerprint.  Fingerprints that may be
    frequent (at most ``COUNTERS``, by a Misra-Gries summary) are joined on the map side."""
    found = fps.freqItems(["fp"], max(1.0 / COUNTERS, 1e-4)).first()
    often = list(found[0] or []) if found else []
    is_often = F.col("fp").isin(often) if often else F.lit(False)
    hot = fps.filter(is_often).join(F.broadcast(of.filter(is_often)), "fp")
    return hot.unionByName(fps.filter(~is_often).join(of.filter(~is_often), "fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    A null or empty text (or one without words) has fingerprint zero and is
    linked like any other; a null doc_id never is a component_id unless all
    ids of the component are null; repeated rows share a component; an empty
    table gives no rows; other columns are not read.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return _of_rows(fps, stage(_of_fingerprints(fps, max_bits), "components")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (a
    null id last), all columns."""
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"), F.col("th").alias("th")))
    # one row of each fingerprint first, so that no join sees a fingerprint's copies
    per = fps.groupBy("fp").agg(first.alias("k"))
    one = per.join(_of_fingerprints(fps, max_bits), "fp").groupBy("root").agg(F.min("k").alias("k"))
    one = stage(one.select(F.col("k.id").alias("doc_id"), F.col("k.th").alias("th")), "survivors")
    # rows that repeat the survivor's id and text are counted, so that one of them stays
    n = fps.join(one, fps["doc_id"].eqNullSafe(one["doc_id"]) & (fps["th"] == one["th"]), "left_semi")
    return keep_rows(docs, n.select("doc_id", "th"), id_col, text_col)
