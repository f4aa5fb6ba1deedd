"""Exact de-duplication with a heavy-hitter split.

Texts are equal when identical after deleting every space character.  A
Misra-Gries summary (``DataFrame.freqItems``, a mergeable aggregate with a
fixed number of counters) finds every digest that may hold more than
``1 / counters`` of the rows; an exact count verifies them, and the verified
winners - at most ``counters`` rows, so a proven size - are broadcast: rows of
those groups are decided on the map side and never shuffled by their hot key.
All other digests use ordinary shuffling, where no key holds more than
``1 / counters`` of the rows.

Only narrow rows (id, length, 32-byte digest) are staged and shuffled, never a
text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import SPACES, stage, whole_text

COUNTERS = 2048


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, hash of the text as it is, code points,
    digest of the normalised text."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"),
                       F.length(text).alias("n_cp"),
                       F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"))


def _winner():
    """Most code points, then smallest id (a null id last), then the text's hash."""
    return F.min(F.struct((-F.col("n_cp")).alias("a"), F.col("doc_id").isNull().alias("b"),
                          F.col("doc_id").alias("id"), F.col("th").alias("th"))).alias("keep")


def heavy_winners(tab: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The groups that hold more than 1/counters of the rows, with exact sizes
    and winners.  At most ``counters`` rows."""
    total = tab.count()
    least = total / counters
    # the summary's keys (at most ``counters`` 64-bit hashes) come to the driver
    keyed = tab.select(F.xxhash64("digest").alias("k"))
    found = keyed.freqItems(["k"], max(1.0 / counters, 1e-4)).first()
    candidates = list(found[0] or []) if found else []
    sized = (tab.filter(F.xxhash64("digest").isin(candidates))
                .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _winner()))
    return sized.filter(F.col("group_size") > F.lit(least))


def _decided(docs: DataFrame, id_col: str, text_col: str, counters: int) -> DataFrame:
    """doc_id, th, digest, group_size, keep of every row."""
    tab = stage(digests(docs, id_col, text_col), "digests")
    heavy = stage(heavy_winners(tab, counters), "heavy")
    hot = heavy.select("digest", F.col("group_size").alias("hot_size"), F.col("keep").alias("hot_keep"))
    marked = tab.join(F.broadcast(hot), "digest", "left")
    cols = ["doc_id", "th", "digest", "group_size", "keep"]
    decided = marked.filter(F.col("hot_size").isNotNull()).select(
        "doc_id", "th", "digest", F.col("hot_size").alias("group_size"), F.col("hot_keep").alias("keep"))
    light = marked.filter(F.col("hot_size").isNull()).select("doc_id", "th", "n_cp", "digest")
    groups = light.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _winner())
    rest = light.select("doc_id", "th", "digest").join(groups, "digest")
    return decided.select(*cols).unionByName(rest.select(*cols)).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep.id")) & (F.col("th") == F.col("keep.th")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty (all empty texts are one group); an empty table
    gives no rows; a null doc_id loses every tie; rows that repeat both doc_id
    and text are all marked kept (``dedup`` returns one of them).  Other
    columns of ``docs`` are not read, whatever their names.
    """
    return _decided(docs, id_col, text_col, counters).select(
        "doc_id", F.col("keep.id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text hash are in ``kept`` (doc_id, th),
    each once.  Rows that repeat both are reduced to one; that step runs only
    when the (narrow) table of keys shows that any key repeats."""
    keys = stage(kept.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")), "kept")
    side = keys.select(F.col("doc_id").alias("__kept_id"), F.col("th").alias("__kept_th"))
    out = docs.join(side, F.col(id_col).eqNullSafe(F.col("__kept_id"))
                    & (F.xxhash64(whole_text(text_col)) == F.col("__kept_th")), "left_semi")
    if keys.filter("n > 1").limit(1).count():
        out = out.dropDuplicates([id_col, text_col])
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns."""
    kept = _decided(docs, id_col, text_col, counters).filter("kept").select("doc_id", "th")
    return keep_rows(docs, kept, id_col, text_col)
