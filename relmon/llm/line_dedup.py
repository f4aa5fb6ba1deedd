"""Line de-duplication by a log-template tree.

The tree has a fixed depth: the first level is a line's number of tokens, the
next its first ``LEAD`` tokens, where a token with a digit counts as a
variable field ``<*>``.  A leaf that lines of several documents reach is
generalised: at each further position a token stays a constant if enough
documents have it there, else it becomes ``<*>`` too.  Lines of a leaf with
the same generalised tokens share a template.  A template with a sufficient
share of constants that recurs in ``MIN_DOCS`` documents is dropped from all
of them but the first (by doc_id and line number), so the text is not lost
from the corpus.  The result does not depend on the order of rows.

Two passes read the texts.  The first keeps (document, line number, hashes, leaf)
only.  Hot leaves are found by map-side combined counts; a bitmap over their hashes, as
large as their number asks for, then lets the second pass keep few other lines (beyond
``MAX_BITS`` a semi-join does, with the same result).  Everything after that works on
the distinct lines of hot leaves.  Equal lines are combined before they are
counted, so a line in a third of all documents is one row.

A document is its id and a hash of its text: rows of one id with different texts, or
without an id, are documents of their own; rows that repeat both are one.  What makes
lines equal, or of one template, are 128 bits of hash.

With ``exact_docs`` equal lines (the same words, digits and all) of at least
``EXACT_TOKENS`` words go from their second document on already: nothing was
generalised there.  Only hashes of lines are counted for that.  Shorter lines
are guarded by ``MIN_DOCS``.  With ``by_support`` the needed share of constants
falls as a template's documents grow, so lines with several variable fields go
too.  The registered query asks for all of it (``WHOLE``); lines without a word
always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import SPACES, stage, whole_text

LEAD = 3
MIN_TOKENS = 5           # shorter lines are left alone
MIN_DOCS = 3
MIN_CONSTANT = 0.8       # share of constant tokens of a template
EXACT_TOKENS = 5         # equal lines of so many words need exact_docs documents only, shorter ones min_docs
# (documents, share of constants, constants after the leading tokens or all there are): with more
# documents a template needs fewer constants
BY_SUPPORT = ((10, 0.5, 1), (100, 0.0, 2))
WHOLE = {"exact_docs": 2, "min_tokens": 1, "by_support": BY_SUPPORT}    # limits of the registered query
BITS_PER_LEAF = 16
MIN_BITS, MAX_BITS = 16, 26      # powers of two of the bitmap's size: 8 MB at most
VARIABLE = "<*>"
FIELD = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"      # a word with a digit, found from its begin only
DOC = ("doc_id", "th")


def _hash(*cols) -> Column:
    """128 bits."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def _one_space(text: Column) -> Column:
    """White space but \\n as spaces; most texts have no other."""
    other = [c for c in SPACES if c not in " \n"]
    found = F.lit(False)
    for c in other:
        found = found | F.contains(text, F.lit(c))
    return F.when(found, F.translate(text, "".join(other), " " * len(other))).otherwise(text)


def _joined_words(line: Column) -> Column:
    """The words of a line (its white space being spaces) joined by one space."""
    x = F.trim(line)
    return F.when(F.contains(x, F.lit("  ")), F.array_join(F.array_remove(F.split(x, " "), ""), " ")).otherwise(x)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("x"))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_tokens: int) -> DataFrame:
    """(doc_id, th, line_no, line, same, n, leaf) of the lines that are long enough;
    ``line`` has its variable fields masked, equal lines have the same ``same``."""
    # outer: no filter on the size of the array is inferred, which would split the text twice.  A text is
    # searched for a digit once; of most texts no line is
    d = _documents(docs, id_col, text_col).select(*DOC, F.col("x").rlike("[0-9]").alias("digit"), _one_space(F.col("x")).alias("x"))
    d = d.select(*DOC, "digit", F.posexplode_outer(F.split("x", "\n")).alias("line_no", "x"))
    d = d.select(*DOC, "digit", "line_no", _joined_words(F.col("x")).alias("raw")).filter(F.col("raw") != "")
    # a space is one byte
    n = F.octet_length("raw") - F.octet_length(F.replace(F.col("raw"), F.lit(" "), F.lit(""))) + 1
    masked = F.when(F.col("digit") & F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", FIELD, VARIABLE)).otherwise(F.col("raw"))
    d = d.select(*DOC, "line_no", masked.alias("line"), _hash("raw").alias("same"), n.alias("n"))
    if min_tokens > 1:          # what is left has a word
        d = d.filter(F.col("n") >= min_tokens)
    return d.withColumn("leaf", F.xxhash64("n", F.substring_index("line", " ", LEAD)))


def _bit(leaf: Column, bits: int) -> tuple[Column, Column]:
    n = leaf.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    return F.shiftright(n, 6).cast("int"), n.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(hot: DataFrame, bits: int) -> Column:
    """2^bits bits over the hot leaves as an array of longs (a scalar subquery)."""
    spark = hot.sparkSession
    word, bit = _bit(F.col("leaf"), bits)
    set_ = hot.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    full = spark.range(0, 1 << (bits - 6), numPartitions=1).select(F.col("id").cast("int").alias("w")) \
                .join(set_, "w", "left").select("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    full = stage(full, "leaf-bitmap")
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("a")).scalar()


def _of_hot_leaves(lines: DataFrame, hot: DataFrame) -> DataFrame:
    """The lines of hot leaves, and maybe a few others, whose templates have too few documents in the end."""
    bits = max(MIN_BITS, (hot.count() * BITS_PER_LEAF - 1).bit_length())
    if bits > MAX_BITS:
        return lines.join(hot, "leaf", "left_semi")
    word, bit = _bit(F.col("leaf"), bits)
    return lines.withColumn("__map", _bitmap(hot, bits)) \
                .filter(F.call_function("shiftright", F.get("__map", word), bit).bitwiseAND(F.lit(1)) == 1).drop("__map")


def _templates(distinct: DataFrame, min_docs: int) -> DataFrame:
    """(lid, template, n_const, n_tail, n) of the distinct lines of hot leaves;
    n_tail counts the constants after the leading tokens.

    distinct: (lid, leaf, line, n_docs), line being the tokens joined by
    spaces.  A token in its place of a leaf is one 64-bit key, so what is
    shuffled for each token is numbers; a template is the hash of the keys that
    are constants.  The leading tokens, shared by the whole leaf, always are."""
    tokens = F.split("line", " ")
    keys = F.filter(F.transform(tokens, lambda t, i: F.when(t != VARIABLE, F.struct(i.alias("pos"), F.xxhash64("leaf", i, t).alias("k")))),
                    lambda x: x.isNotNull())
    t = distinct.select("lid", "n_docs", F.explode_outer(keys).alias("e")).select("lid", "n_docs", "e.pos", "e.k")
    common = t.groupBy("k").agg(F.sum("n_docs").alias("s")).filter(F.col("s") >= min_docs).select("k")
    g = t.select("lid", "pos", "k").join(common, "k").groupBy("lid").agg(
        F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("p"))
    sizes = distinct.select("lid", F.size(tokens).alias("n"))
    return g.join(sizes, "lid").select("lid", _hash(F.transform("p", lambda x: x["k"])).alias("template"),
                                       F.size("p").alias("n_const"),
                                       F.size(F.filter("p", lambda x: x["pos"] >= LEAD)).alias("n_tail"), "n")


def _needed(min_docs: int, min_constant: float, by_support: tuple) -> Column:
    """The documents a template must have; null if no number suffices."""
    need = F.when(F.col("n_const") >= F.lit(min_constant) * F.col("n"), min_docs)
    # prose that starts alike has constants in front only and no field among them
    field_in_front = F.col("n_const") - F.col("n_tail") < F.least(F.col("n"), F.lit(LEAD))
    for docs, share, tail in by_support:
        guard = F.col("n_tail") >= F.least(F.lit(tail), F.greatest(F.col("n") - LEAD, F.lit(0)))
        need = need.when((F.col("n_const") >= F.lit(share) * F.col("n")) & (guard | (F.lit(share > 0) & field_in_front)), docs)
    return need


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("line_no").alias("l"))


def _others(at: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """(doc_id, th, line_no) of the rows of ``at`` whose key is in ``kept``, but its first row."""
    is_first = F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("th") == F.col("ft")) & (F.col("line_no") == F.col("fl"))
    return at.join(kept, key).filter(~is_first).select(*DOC, "line_no")


def _recurring(at: DataFrame, key: str, *more: str) -> DataFrame:
    """key, n_docs, the first row's place, maxima of ``more``; at: (doc_id, th, line_no, key, more)."""
    in_docs = at.groupBy(key, *DOC).agg(F.min("line_no").alias("line_no"), *[F.max(c).alias(c) for c in more])
    return in_docs.groupBy(key).agg(F.count(F.lit(1)).alias("n_docs"), F.min(_order()).alias("first"), *[F.max(c).alias(c) for c in more]) \
                  .select(key, "n_docs", F.col("first.d").alias("fd"), F.col("first.t").alias("ft"), F.col("first.l").alias("fl"), *more)


def _equal_lines(lines: DataFrame, exact_docs: int, min_docs: int) -> DataFrame:
    """(doc_id, th, line_no) of equal lines but the first.  lines: (doc_id, th, line_no, same, n)."""
    need = F.when(F.col("n") >= EXACT_TOKENS, exact_docs).otherwise(min_docs)
    kept = _recurring(lines, "same", "n").filter(F.col("n_docs") >= need).select("same", "fd", "ft", "fl")
    return _others(lines, kept, "same")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
                  min_tokens: int = MIN_TOKENS, min_constant: float = MIN_CONSTANT, exact_docs: int | None = None,
                  by_support: tuple = ()) -> DataFrame:
    """(doc_id, th, line_no) of every line that goes, maybe more than once."""
    lines = _lines(docs, id_col, text_col, min_tokens)
    keys = lines
    if exact_docs:
        keys = stage(lines.select(*DOC, "line_no", "same", "leaf", "n"), "line-keys")
    # hot leaves: those of at least min_docs documents
    pairs = keys.select(*DOC, "leaf").groupBy("leaf", *DOC).agg(F.count(F.lit(1)).alias("k"))
    hot = stage(pairs.groupBy("leaf").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= min_docs).select("leaf"),
                "leaves")
    # second pass: the lines of hot leaves
    passed = _of_hot_leaves(lines.select(*DOC, "line_no", "leaf", "line"), hot)
    h = stage(passed.withColumn("lid", _hash("leaf", "line")), "hot-lines")
    in_docs = h.groupBy("lid", *DOC).agg(F.count(F.lit(1)).alias("k")).groupBy("lid").agg(F.count(F.lit(1)).alias("n_docs"))
    one = h.select("lid", "leaf", "line").dropDuplicates(["lid"])
    distinct = stage(one.join(in_docs, "lid"), "distinct-lines")
    tpl = _templates(distinct, min_docs).select("lid", "template", _needed(min_docs, min_constant, by_support).alias("need"))
    at = stage(h.select(*DOC, "line_no", "lid").join(tpl.filter(F.col("need").isNotNull()), "lid")
                .select(*DOC, "line_no", "template", "need"), "template-lines")
    kept = _recurring(at, "template", "need").filter(F.col("n_docs") >= F.col("need")).select("template", "fd", "ft", "fl")
    gone = _others(at, kept, "template")
    return gone.unionByName(_equal_lines(keys, exact_docs, min_docs)) if exact_docs else gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per input row: doc_id, text (without the dropped lines), n_lines,
    n_dropped (lines) and n_chars (code points of the new text).

    Lines are cut at \\n; a null text counts as empty, one empty line.  Rows of
    one doc_id with different texts are different documents, and so are rows without
    an id; rows that repeat id and text are one document.  A null doc_id comes last
    among the documents of a template, then the text's hash decides.  An empty table
    gives no rows; other columns are not read.  A document all of whose lines are
    dropped has an empty text.
    """
    gone = dropped_lines(docs, id_col, text_col, **limits).groupBy(*DOC).agg(F.collect_set("line_no").alias("gone"))
    side = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "gone")
    d = _documents(docs, id_col, text_col).join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    d = d.withColumn("l", F.split("x", "\n"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    d = d.withColumn("k", keep)
    # only a text that loses lines is put together anew
    text = F.when(F.size("k") == F.size("l"), F.col("x")).otherwise(
        F.array_join(F.transform("k", lambda i: F.get(F.col("l"), i)), "\n"))
    d = d.select("doc_id", text.alias("text"), F.size("l").alias("n_lines"),
                 (F.size("l") - F.size("k")).alias("n_dropped"))
    return d.withColumn("n_chars", F.length("text"))
