"""Mixing sources to target weights by temperature.

The token shares p of the sources are raised to an exponent between 0 (equal
weights) and 1 (as they are) and normalised.  The exponent is bisected on a
grid: either the largest whose weights have at least a target entropy, or the
smallest whose most repeated source stays within a repetition limit.  Each
bisection job evaluates a fixed number of exponents over the table of sources
at once and returns that many rows; the table itself stays distributed.

Weights are realised as budgeted block permutations.  A document's block is a
hash of its id; every epoch of a source is its own permutation of the blocks.
A source with a quota of tokens gets whole epochs while they fit, then the
blocks of one more epoch, in its order, while they fit.  So only (source,
block) sums are ordered, at most ``BLOCKS`` rows a source, and a source that
holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmon.llm.common import stage, whole_text, words

BLOCKS = 256
REPETITION_LIMIT = 2.0
GRID_BITS = 20               # the exponent is a multiple of 2^-20
STEP_BITS = 4                # bits found by one job
SEED = "mix"


def _hash32(*parts: Column) -> Column:
    """First 32 bits of the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def block_of(id_col: Column, blocks: int = BLOCKS) -> Column:
    return (_hash32(id_col) % blocks).cast("int")


def shares(narrow: DataFrame) -> DataFrame:
    """(source, tokens, p): token sums and shares of the sources with tokens."""
    t = stage(narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = t.agg(F.sum("tokens")).scalar()
    return stage(t.filter("tokens > 0").withColumn("p", F.col("tokens") / total), "shares")


def _evaluate(p: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """For each exponent: entropy, and largest and smallest of weight / share."""
    a = p.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    w = F.pow("p", F.col("a"))
    r = a.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log("p")).alias("s"),
                           F.max(F.pow("p", F.col("a") - 1)).alias("hi"), F.min(F.pow("p", F.col("a") - 1)).alias("lo"))
    return {x["a"]: (math.log(x["z"]) - x["a"] * x["s"] / x["z"], x["hi"] / x["z"], x["lo"] / x["z"])
            for x in r.collect()}       # as many rows as exponents


def bisect(p: DataFrame, total: int, target_entropy: float | None = None,
           repetition_limit: float | None = REPETITION_LIMIT, budget: int | None = None) -> float:
    """The exponent.  Without a budget the smallest is meant that uses every
    source at least once; 1.0 (no change) if the table has no tokens."""
    def meets(v: tuple[float, float, float]) -> bool:
        entropy, hi, lo = v
        if target_entropy is not None:
            return entropy < target_entropy          # true from some exponent on
        repeats = hi / lo if budget is None else hi * budget / total
        return repeats <= repetition_limit           # likewise
    if not total:
        return 1.0
    low, high, top = -1, 1 << GRID_BITS, 1 << GRID_BITS     # meets: not at low, taken to be so at high
    while high - low > 1:
        step = max(1, (high - low) >> STEP_BITS)
        grid = list(range(low + step, high, step))
        got = _evaluate(p, [k / top for k in grid])
        for k in grid:
            if meets(got[k / top]):
                high = k
                break
            low = k
    if target_entropy is not None:
        high = max(0, high - 1)                      # the last that still has the entropy
    return high / top


def plan(narrow: DataFrame, target_entropy: float | None = None,
         repetition_limit: float | None = REPETITION_LIMIT, budget: int | None = None) -> DataFrame:
    """(source, block, weight, copies): how often each block of a source is taken.

    narrow: (source, block, n_tokens) a document.  A null source is a source
    of its own.  Sources without tokens take no weight; their documents, which
    cost nothing, are taken once.
    """
    p = shares(narrow)
    total = p.agg(F.sum("tokens")).first()[0] or 0
    a = bisect(p, total, target_entropy, repetition_limit, budget)
    w = F.pow("p", F.lit(a))
    z = p.agg(F.sum(F.pow("p", F.lit(a)))).scalar()
    weighted = stage(p.select("source", "tokens", "p", (w / z).alias("weight")), "weights")
    spend = (F.lit(float(budget)) if budget is not None
             else F.lit(float(total)) * weighted.agg(F.max(F.col("p") / F.col("weight"))).scalar())
    quota = weighted.select(
        F.col("source").alias("q_source"), "weight", "tokens",
        # a quota that is an epoch but for rounding is that epoch
        F.floor(F.col("weight") * spend + F.lit(1e-6) * F.col("tokens")).alias("quota"))
    sums = narrow.groupBy("source", "block").agg(F.sum("n_tokens").alias("b_tokens"))
    j = sums.join(quota, F.col("source").eqNullSafe(F.col("q_source")), "left")
    epochs = F.floor(F.col("quota") / F.col("tokens"))
    j = j.withColumn("epochs", epochs).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    j = j.withColumn("rank", _hash32(F.col("epochs"), F.col("source"), F.col("block")))
    seen = Window.partitionBy("source").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = j.withColumn("sofar", F.sum("b_tokens").over(seen))
    return j.select("source", "block", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                    F.when(F.col("weight").isNull(), F.lit(1)).otherwise(
                        F.col("epochs") + (F.col("sofar") <= F.col("rest")).cast("int")).cast("long").alias("copies"))


def mixture_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                   **target) -> DataFrame:
    """One row per input row: doc_id, source, n_tokens (words), block, weight
    (of the source), copies (how often the document is in the mixture).

    A null or empty text has no tokens; a null doc_id hashes like an empty
    one; repeated rows get the same block; an empty table gives no rows; other
    columns are not read.
    """
    narrow = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                               F.size(words(whole_text(text_col))).cast("long").alias("n_tokens"),
                               block_of(F.col(id_col)).alias("block")), "tokens")
    copies = stage(plan(narrow.drop("doc_id"), **target), "blocks")
    c = copies.select(F.col("source").alias("c_source"), F.col("block").alias("c_block"), "weight", "copies")
    return narrow.join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block"))).select(
        "doc_id", "source", "n_tokens", "block", F.round("weight", 9).alias("weight"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        **target) -> DataFrame:
    """The mixture: rows of ``docs`` as often as they are taken, all columns.

    The table of blocks is joined without a hint: Spark broadcasts it if its
    size allows, else shuffles by (source, block), which splits a hot source."""
    narrow = stage(docs.select(F.col(source_col).alias("source"),
                               F.size(words(whole_text(text_col))).cast("long").alias("n_tokens"),
                               block_of(F.col(id_col)).alias("block")).groupBy("source", "block")
                       .agg(F.sum("n_tokens").alias("n_tokens")), "tokens")
    copies = stage(plan(narrow, **target), "blocks")
    c = copies.select(F.col("source").alias("__source"), F.col("block").alias("__block"), F.col("copies").alias("__copies"))
    rows = docs.withColumn("__at", block_of(F.col(id_col))).join(
        c, F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__at") == F.col("__block")))
    # as many rows as copies; none is wanted for 0
    times = F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return rows.withColumn("__epoch", F.explode(times)).select(*docs.columns)
