"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets.  Two multinomials
over the buckets are estimated, one from
the whole raw corpus and one from trusted documents (smoothed by the raw one);
the mean over a document's n-grams of log(p_trusted / p_raw) is its
length-normalised log-likelihood ratio.  The trusted documents are in two
folds by the parity of the hashed id, and every document is scored by the
model of the fold it can't be in, so none is judged by its own n-grams.  The
threshold is the ratio that all but ``REJECTED`` of the trusted documents
reach; it is computed once and holds for every document.

The raw counts cover every document of the table, the trusted multinomials and
the threshold every trusted one; nothing is sampled.  The number of buckets
follows the size of the corpus (``bucket_count``): the fitted table reaches the
scoring pass as one value, so its size is bounded by ``MAX_BUCKETS``.  The trusted
ids grow with the labels, so they are never broadcast: the fit shuffles the texts
once, beside which the ids of a partition are hashed (texts aren't sorted).  The
counts are combined on the map side into at most 2 x buckets rows a task.

One array of word hashes is made per text and hashed on in pairs: hashes of two
words are the pairs of the ratio, and, paired again and again, the windows of
eight words of the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import SPACES, stage, whole_text, words

MIN_BUCKETS, MAX_BUCKETS = 1 << 16, 1 << 20     # for each order of n-gram
CHARS_PER_BUCKET = 1 << 14   # code points of the corpus for each bucket, between those bounds
PRIOR = 0.5                  # weight of the raw model in a trusted one, in sizes of the trusted documents
REJECTED = 0.001             # share of trusted documents below the threshold
SKETCH = 10_000              # accuracy of the sketch that bounds the threshold: an error of 1 / SKETCH in rank
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8                   # words: three doublings
# Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


def bucket_count(docs: DataFrame, text_col: str = "text") -> int:
    """Buckets for each order of n-gram: a power of two that grows with the corpus."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    n = MIN_BUCKETS
    while n < MAX_BUCKETS and n * CHARS_PER_BUCKET < chars:
        n *= 2
    return n


def _hashes(w: Column) -> Column:
    """Hashes of the words; the last bit is 1, that of a pair is 0."""
    return F.transform(w, lambda x: F.xxhash64(x).bitwiseOR(F.lit(1).cast("long")))


def _joined(h: Column, k: int) -> Column:
    """Hashes of each element and the one ``k`` behind it."""
    return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - k, F.lit(0))), F.slice(h, k + 1, F.size(h)),
                      lambda a, b: F.xxhash64(a, b).bitwiseAND(F.lit(-2).cast("long")))


def _bucket(h: Column, buckets: int) -> Column:
    """Bucket of an n-gram's hash: odd numbers are words, even ones pairs."""
    return h.bitwiseAND(F.lit(2 * buckets - 1).cast("long")).cast("int")


def _fold(id_col: str) -> Column:
    return F.xxhash64(F.lit("fold"), F.col(id_col)).bitwiseAND(F.lit(1)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good and not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
    return good.select("doc_id").distinct()


def _with_trust(docs: DataFrame, ids: DataFrame, id_col: str, spread_by: str) -> DataFrame:
    """Adds __t, 1 for trusted documents.  Rows without an id match none and are
    spread by the hash of ``spread_by``, so that they don't meet in one task."""
    mark = ids.select(F.col("doc_id").alias("__tid"), F.lit(0).cast("long").alias("__ts"), F.lit(1).alias("__t"))
    salt = F.when(F.col(id_col).isNull(), F.xxhash64(spread_by)).otherwise(F.lit(0).cast("long"))
    match = (F.col(id_col) == F.col("__tid")) & (salt == F.col("__ts"))
    return docs.join(mark.hint("shuffle_hash"), match, "left").drop("__tid", "__ts")


def _trusted_rows(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    mark = ids.withColumnRenamed("doc_id", "__tid").hint("shuffle_hash")
    return docs.join(mark, F.col(id_col) == F.col("__tid")).drop("__tid")


def fit(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        buckets: int = MIN_BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, llr0, llr1) for every one of the 2 x buckets buckets: llr0 is
    for documents of fold 0 and fitted on the trusted ones of fold 1."""
    spark = docs.sparkSession
    rows = _with_trust(docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("x")), ids, "id", "x")
    fold = F.when(F.col("__t") == 1, _fold("id"))
    each = rows.select(fold.alias("fold"), _hashes(words(F.col("x"))).alias("h"))
    grams = each.select("fold", F.explode(F.concat("h", _joined(F.col("h"), 1))).alias("g")).select("fold", _bucket(F.col("g"), buckets).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"),
                                         F.count(F.when(F.col("fold") == 1, 1)).alias("good0"),
                                         F.count(F.when(F.col("fold") == 0, 1)).alias("good1"))
    zero = F.lit(0).cast("long")
    full = (spark.range(0, 2 * buckets, numPartitions=1).select(F.col("id").cast("int").alias("bucket"))
                 .join(counts, "bucket", "left")
                 .select("bucket", *[F.coalesce(c, zero).alias(c) for c in ("raw", "good0", "good1")],
                         (F.col("bucket") % 2 == 0).alias("pair")))
    full = stage(full, "ngram-counts")
    sums = full.groupBy("pair").agg(*[F.sum(c).alias(f"n_{c}") for c in ("raw", "good0", "good1")])

    def ratio(c: str) -> Column:
        # (good + prior * n_good * p_raw) / (n_good * (1 + prior)) / p_raw
        n = F.col(f"n_{c}")
        seen = F.col(c) * F.col("n_raw") / F.col("raw") / n
        return F.when((n == 0) | (F.col("raw") == 0), F.lit(0.0)).otherwise(F.log((seen + prior) / (1 + prior)))
    return full.join(sums, "pair").select("bucket", ratio("good0").alias("llr0"), ratio("good1").alias("llr1"))


def _score(d: DataFrame, model: DataFrame, fold: Column, buckets: int, to: str) -> DataFrame:
    """Adds the mean ratio of the words ``__h1`` and pairs ``__h2``.  The model is a
    scalar subquery; the column that holds it is used once, so the optimizer moves it
    into the expression and it is not copied into rows (a test looks at the
    plan)."""
    def arr(c: str) -> Column:
        return model.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", c))), lambda x: x[c]).alias(c)).scalar()
    d = d.withColumn("__m", F.when(fold == 0, arr("llr0")).otherwise(arr("llr1")))

    def total(a: Column) -> Column:
        return F.aggregate(F.concat("__h1", "__h2"), F.lit(0.0), lambda s, h: s + F.get(a, _bucket(h, buckets)))
    n = F.size("__w")
    return d.withColumn(to, F.when(n > 0, F.get(F.transform(F.array("__m"), total), F.lit(0)) / (2 * n - 1))
                        .otherwise(F.lit(0.0))).drop("__m")


def threshold_of(trusted: DataFrame, rejected: float = REJECTED) -> float:
    """The ratio that all but ``rejected`` of the trusted documents reach;
    without trusted documents, one that every document reaches.  trusted: n_words
    and llr of those documents."""
    low = _low_quantile(trusted.filter(F.col("n_words") >= MIN_WORDS).select("llr"), rejected)
    return float("-inf") if low is None else low


def _low_quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of the column llr, between two values as ``percentile``
    has it.  A sketch says which values are low enough to matter; only those, about
    ``share`` of all, are brought together."""
    n, cut = values.agg(F.count("llr"), F.percentile_approx("llr", F.lit(min(1.0, share + 2 / SKETCH)), F.lit(SKETCH))).first()
    if not n:
        return None
    at = share * (n - 1)
    k = int(at)
    most = min(k + 2, n)
    low = values.filter(F.col("llr") <= F.lit(cut))
    if low.count() < most:
        low = values
    near = [r[0] for r in low.orderBy("llr").limit(most).orderBy(F.desc("llr")).limit(most - k).collect()]
    return near[-1] if at == k or near[0] == near[-1] else (k + 1 - at) * near[-1] + (at - k) * near[0]


def _repeat_words(d: DataFrame) -> DataFrame:
    """Adds __rep: words inside 8-word windows that occur twice or more."""
    # hashes of 2, 4 and then 8 words, each of two of the one before
    d = d.withColumn("__h", F.when(F.size("__w") > WINDOW, F.col("__h2")))
    for k in (2, 4):
        d = d.withColumn("__h", _joined(F.col("__h"), k))
    # (hash, position) in order; equal neighbours are found twice or more
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.array_sort(
        F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__s")
    d = d.withColumn("__p", F.array_sort(F.transform(
        F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True)
                 | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True)), lambda x: x["i"])))
    p = F.col("__p")
    new = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
    rep = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("__rep", F.coalesce(rep, F.lit(0).cast("long"))).drop("__h", "__s", "__p")


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept")


def _scored(docs: DataFrame, model: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``docs`` with a struct column ``__quality`` of the fields ``RESULT`` but kept."""
    d = docs.withColumn("__x", whole_text(text_col)).withColumn("__w", words(F.col("__x")))
    d = d.withColumn("__h1", _hashes(F.col("__w")))
    d = _repeat_words(d.withColumn("__h2", _joined(F.col("__h1"), 1)))
    lines = F.filter(F.split("__x", "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    d = d.withColumn("__l", lines)
    n = F.size("__w").cast("long")
    d = _score(d, model, _fold(id_col), buckets, "__llr")
    failed = (n < MIN_WORDS) | (F.lit(100) * F.col("__rep") > F.lit(MAX_REPEAT_PERCENT) * n)
    quality = F.struct(
        n.alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__x", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.col("__rep").alias("n_repeat_words"), F.col("__llr").alias("llr"), failed.alias("base_failed"))
    # through a generator, so that a filter on the verdict is not moved below it, where it would repeat all of the above
    return d.select(*[F.col(c) for c in docs.columns], F.explode_outer(F.array(quality)).alias("__quality"))


def _kept(threshold: float) -> Column:
    return ~F.col("__quality.base_failed") & (F.col("__quality.llr") >= F.lit(threshold))


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int | None) -> tuple[DataFrame, DataFrame, int]:
    buckets = buckets or bucket_count(docs, text_col)
    ids = stage(trusted_ids(labels), "trusted")
    return ids, stage(fit(docs, ids, id_col, text_col, buckets), "ngram-llr"), buckets


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   buckets: int | None = None) -> DataFrame:
    """One row per input row: doc_id and the fields ``RESULT``.

    Every document is scored once; the threshold is read off the scores, which
    are written as a narrow table.  Row-local after the fit, so repeated rows
    and null ids are judged like any other.  A null text counts as empty: no
    words, base_failed.  An empty table gives no rows.  Without labels every
    ratio is 0 and the base rules decide.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids, model, buckets = _model(slim, labels, "doc_id", "text", buckets)
    scored = stage(_scored(slim, model, "doc_id", "text", buckets).select("doc_id", "__quality"), "quality-scores")
    threshold = threshold_of(_trusted_rows(scored.select("doc_id", "__quality.n_words", "__quality.llr"), ids, "doc_id"))
    return scored.select("doc_id", *[F.col(f"__quality.{c}").alias(c) for c in RESULT if c != "kept"],
                         _kept(threshold).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   buckets: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns.  The verdict is
    taken beside the text; the threshold comes from a first pass over all trusted
    documents."""
    ids, model, buckets = _model(docs, labels, id_col, text_col, buckets)
    trusted = _trusted_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids, "id")
    some = _scored(trusted, model, "id", "text", buckets).select("__quality.n_words", "__quality.llr")
    threshold = threshold_of(stage(some, "trusted-scores"))
    return _scored(docs, model, id_col, text_col, buckets).filter(_kept(threshold)).select(*docs.columns)
