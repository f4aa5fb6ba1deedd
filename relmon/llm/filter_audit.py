"""Filter interaction audit: what each order of a set of filters removes.

A document is reduced to the set of filters that it fails (a bit mask), and the
table to counts of documents per part and mask, at most 2^filters rows a part.
The sets of filters already applied form the subset lattice; an edge
(state, filter) removes the documents that no filter of the state removes and
the edge's filter does.  Path counting runs forward (orders that reach a state
from none) and backward (orders that leave it to all): an edge lies on
forward x backward orders, which weights its removals to the Shapley sum, and
the steps of any single order are read off the same edges.

The masks of the four text filters come from one Arrow pass over the texts; the
duplicate filter from narrow rows (id, digest), joined on both so that many
copies of one text are no hot key.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import stage

FILTERS = "ABCDE"
MIN_WORDS = 50          # A: fewer words
MIN_DISTINCT = 65       # B: fewer distinct words, in percent
MAX_UPPER = 5           # C: more capitals A-Z, in percent of the code points
# The characters of filter C and of filter D.
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = re.compile(rb"[#$%&*|]")

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


# ---------------------------------------------------------------- which filters a document fails

def text_mask(text: bytes, code_points: int) -> int:
    """Bits of the failed text filters A to D of one UTF-8 text."""
    words = text.split()            # of bytes: [\x20\x09-\x0D]
    upper = len(text) - len(text.translate(None, UPPER))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * len(words)) << 1
            | (100 * upper > MAX_UPPER * code_points) << 2 | (SYMBOLS.search(text) is not None) << 3)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        masks, digests = [], []
        for text, n in zip(b.column(2), b.column(3)):
            t = text.as_buffer().to_pybytes()
            masks.append(text_mask(t, n.as_py()))
            digests.append(hashlib.sha256(t).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                                         names=["doc_id", "part", "mask", "digest"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask of every row.  A null text is empty, a null part the
    empty string.  Filter E fails for a row whose text some row of a smaller id
    has; a null id is no smaller and has none, rows of one id and text don't
    fail by each other."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.cast("binary").alias("text"), F.length(text).cast("long").alias("n"))
    tab = stage(rows.mapInArrow(_masks, f"doc_id {kind}, part string, mask int, digest binary"), "filter-masks")
    first = tab.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = tab.filter(F.col("doc_id").isNotNull()).join(first, ["digest", "doc_id"], "left")
    e = 1 << FILTERS.index("E")
    known = known.select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(e))).alias("mask"))
    return known.unionByName(tab.filter(F.col("doc_id").isNull()).select("doc_id", "part", "mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, documents, good, toxic.  A document is good (toxic) if any of
    its rows in ``labels`` says 1; without a row, or with nulls, it is neither."""
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = failed.filter(F.col("doc_id").isNotNull()).join(one, "doc_id", "left").select("part", "mask", "good", "toxic")
    no = F.lit(False)
    rows = known.unionByName(failed.filter(F.col("doc_id").isNull()).select("part", "mask", no.alias("good"), no.alias("toxic")))

    def number(c: str) -> Column:
        return F.count(F.when(F.col(c), 1)).alias(c)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("documents"), number("good"), number("toxic"))


# ---------------------------------------------------------------- the lattice

def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every set of ``n`` filters: orders that reach it from the empty set,
    and orders that lead from it to the full one."""
    size = 1 << n
    forward, backward = [0] * size, [0] * size
    forward[0] = backward[size - 1] = 1
    for state in range(size):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(size)):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def lattice_edges(n: int) -> list[tuple[int, int, int]]:
    """(state, filter's bit, orders through the edge) of all n * 2^(n-1) edges."""
    forward, backward = path_counts(n)
    return [(s, 1 << f, forward[s] * backward[s | 1 << f]) for s in range(1 << n) for f in range(n) if not s >> f & 1]


def order_steps(filters: Sequence[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, state, filter's bit) of every order of the filters."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [("".join(order), k + 1, sum(bit[f] for f in order[:k]), bit[order[k]])
            for order in itertools.permutations(filters) for k in range(len(order))]


def _values(rows: list[tuple], names: str) -> Column:
    """A fixed list of rows as an array of structs."""
    cells = ",".join("(" + ",".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    fields = ",".join(f"'{n}',x.col{i + 1}" for i, n in enumerate(names.split()))
    return F.expr(f"transform(array({cells}), x -> named_struct({fields}))")


def edge_removals(cell: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """part, state, bit, orders and the counts of every edge, zeros included."""
    x = cell.select("*", F.explode(_values(lattice_edges(n), "state bit orders")).alias("e")).select("*", "e.*")
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("state")) != 0

    def total(cond: Column, of: str = "documents") -> Column:
        return F.sum(F.when(cond, F.col(of)).otherwise(0))
    return x.groupBy("part", "state", "bit", "orders").agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"), total(fails & ~before, "toxic").alias("toxic_lost"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order,
    step, the counts of ``COUNTS`` and shapley (the removals of the step's filter
    summed over all orders).  Every part has all rows, zeros included; an empty
    table has no part and gives no rows.  Nulls, repeated ids and texts: see
    ``failures`` and ``cells``.  Other columns are not read."""
    cell = stage(cells(failures(docs, id_col, text_col, part_col), labels), "filter-cells")
    edges = stage(edge_removals(cell), "filter-edges")
    shapley = edges.groupBy("part", "bit").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    # a part's edges in one map of 80 entries; its orders are spelled out from it, so nothing is joined with the list of orders
    name = F.concat_ws("-", F.col("state").cast("string"), F.col("bit").cast("string"))
    by_part = edges.join(shapley, ["part", "bit"]).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(name.alias("k"), F.struct(*COUNTS, "shapley").alias("v")))).alias("edges"))
    steps = [(order, step, f"{state}-{bit}") for order, step, state, bit in order_steps(FILTERS)]
    out = by_part.select("part", "edges", F.explode(_values(steps, "filter_order step edge")).alias("s"))
    return out.select("part", "s.filter_order", "s.step", F.element_at("edges", F.col("s.edge")).alias("e")).select(
        "part", "filter_order", "step", *[F.col(f"e.{c}").cast("long").alias(c) for c in (*COUNTS, "shapley")])
