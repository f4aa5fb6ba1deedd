import collections
import hashlib

import corpus_pipeline as C
import public_tokenizers
from test_documents import brute_components, brute_fingerprint

from relmon.llm import mixing, quality_rules
from relmon.llm.oracle import SQL
from relmon.llm.queries import QUERIES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_stages_against_brute_force(spark, sf):
    import re

    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.quality_report(docs, labels).collect() if r.kept}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    assert len(text) < docs.count()
    best = {}
    for i, t in sorted(text.items()):
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        if k not in best or len(t) > len(text[best[k]]):
            best[k] = i
    left = {i: text[i] for i in best.values()}
    comp = brute_components({i: brute_fingerprint(t) for i, t in sorted(left.items())})
    left = {i: t for i, t in left.items() if comp[i] == i}
    step = docs
    for name, f in C.STAGES[:3]:
        step = C.stage(f(spark, step, sf), name)
        assert step.columns == docs.columns
    assert {r.doc_id for r in step.collect()} == set(left)
    copies = {r.doc_id: r.copies for r in mixing.mixture_report(step).collect()}
    assert set(copies) == set(left) and min(copies.values()) >= 1
    out = C.run(spark, sf).collect()
    assert collections.Counter(r.doc_id for r in out) == copies
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in left.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in out)


def test_stages_on_odd_rows_and_empty_tables(spark, odd, none, labels, tmp_path):
    d = str(tmp_path)
    labels.write.parquet(f"{d}/labels.parquet")
    for start in (odd, none):
        docs = start
        for name, f in C.STAGES:
            docs = C.stage(f(spark, start if name != "bpe_codec" else docs, d), name)
            assert docs.count() <= 2 * start.count()
            if name != "bpe_codec":
                assert docs.columns == start.columns


def test_oracle_queries(spark, sf):
    import duckdb

    from tools.oracle_compare import rows_of
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    for name, sql in SQL.items():
        df = QUERIES[name](spark, sf)
        cur = con.execute(sql)
        assert sorted(df.columns) == sorted(c[0] for c in cur.description)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall()), name
