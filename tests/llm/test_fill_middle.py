import hashlib
import random
import re

import pytest
from llm_helpers import clash

from relmon.llm import fill_middle as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(doc_id, text):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "plain" if not t or re.search("<[PSM]>", t) or h3 % 100 >= 100 else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": t, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
    plain = form == "plain"
    return (doc_id, len(u), form, None if plain else len(pre), None if plain else len(mid),
            hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), out


def some_rows():
    rnd = random.Random(11)
    lines = ["", "a", "bb ccc", "é\U0001f600", "x" * 40, "<P", "S>", "<", "\r"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 30))) + rnd.choice(["", "\n"]), "en", "s", 1) for i in range(300)]
    return rows + [(400, "has <P> in it\nx", "en", "s", 1), (401, "<M>", "en", "s", 1), (402, "\n", "en", "s", 1), (403, "\n\n\n", "en", "s", 1),
                   (1, "another text of id 1\nx\n", "en", "s", 1), rows[5], rows[5], (None, "a\nb\n", "en", "s", 1), (None, "a\nb\n", "en", "s", 1),
                   (None, "c\nd\n", "en", "s", 1), (404, "y" * 100_000 + "\n" + "z\n" * 30_000, "en", "s", 1)]


@pytest.mark.parametrize("chunk", [1, 7, 64, M.CHUNK])
def test_against_brute_force(spark, chunk):
    rows = some_rows() if chunk > 1 else some_rows()[:60]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted((brute(r[0], r[1])[0] for r in rows), key=str)
    got = M.digests(docs.repartition(3), chunk=chunk)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({w[2] for w in want}) == (3 if chunk > 1 else 3 if any(w[2] == "plain" for w in want) else 2)


def test_odd_rows_empty_tables_and_clashing_names(spark, odd, odd_rows, none):
    want = sorted((brute(r[0], r[1])[0] for r in odd_rows), key=str)
    assert sorted(map(tuple, M.digests(odd).collect()), key=str) == want
    assert sorted(map(tuple, M.digests(clash(odd)).collect()), key=str) == want
    assert M.digests(none).collect() == [] and M.transform(none).collect() == []


def test_outputs_and_their_restoration(spark):
    rows = some_rows()
    got = M.transform(spark.createDataFrame(rows, DOCS), chunk=64).collect()
    assert sorted(((r.doc_id, r.output) for r in got), key=str) == sorted(((r[0], brute(r[0], r[1])[1]) for r in rows), key=str)
    texts = sorted(((r.doc_id, M.restore(r.output, r.form)) for r in got), key=str)
    assert texts == sorted(((r[0], r[1] or "") for r in rows), key=str)


def test_shares_are_parameters(spark):
    docs = spark.createDataFrame(some_rows()[:200], DOCS)
    forms = {r.form for r in M.digests(docs, fim_percent=0).collect()}
    assert forms == {"plain"}
    assert {r.form for r in M.digests(docs.filter("text <> ''"), spm_percent=100).collect()} <= {"spm", "plain"}


def test_one_shuffle_two_sorts(spark):
    docs = spark.createDataFrame(some_rows(), DOCS)
    plan = M.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and len(re.findall(r"\bSort \[", plan)) == 2
