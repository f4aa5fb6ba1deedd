import collections
import itertools
import random
import re

import pytest
from llm_helpers import clash

from relmon.llm import filter_audit as A


def fails(rows):
    """The set of filters that each row fails, by the words of the contract."""
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = set()
        if len(w) < 50:
            s.add("A")
        if 100 * len(set(w)) < 65 * len(w):
            s.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            s.add("C")
        if re.search(r"[#$%&*|]", t):
            s.add("D")
        if doc_id is not None and any((r[1] or "") == t and r[0] is not None and r[0] < doc_id for r in rows):
            s.add("E")
        out.append(s)
    return out


def brute(rows, labels):
    """Every order applied to the documents, one filter after another."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = collections.defaultdict(list)
    for r, s in zip(rows, fails(rows)):
        parts[r[3] or ""].append((r[0], s))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                all_f = [d for d in docs if f in d[1]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(all_f) - len(gone), sum(d[1] == {f} for d in docs),
                                                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), f]
        for key, v in out.items():
            if key[0] == part:
                v[6] = shapley[v[6]] if isinstance(v[6], str) else v[6]
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def some_rows():
    rnd = random.Random(5)
    rows = []
    for i in range(260):
        n = rnd.choice([0, 3, 49, 50, 80])
        w = [rnd.choice(["alpha", "Beta", "GAMMA", f"w{rnd.randrange(400)}", f"w{rnd.randrange(400)}"]) for _ in range(n)]
        text = rnd.choice([" ", "\n", " ", "\x0b"]).join(w) + rnd.choice(["", "", "#", "$x"])
        rows.append((rnd.choice([None, *range(150)]) if rnd.random() < .2 else i, rnd.choice([None, text, text, text]), "en",
                     rnd.choice(["s1", "s2", None, ""]), 1))
    return rows + rows[:40]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_against_brute_force(spark):
    rows = some_rows()
    rnd = random.Random(6)
    labels = [(rnd.choice([None, *range(260)]), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(200)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = A.audit(docs, lab)
    assert out.count() == 3 * 600
    assert got(out) == brute(rows, labels)
    assert got(A.audit(clash(docs).repartition(7), lab)) == got(out)


def test_odd_rows_and_empty_tables(spark, odd, odd_rows, none, labels):
    want = brute(odd_rows, [tuple(r) for r in labels.collect()])
    assert got(A.audit(odd, labels)) == want
    assert A.audit(none, labels).collect() == []
    assert got(A.audit(odd, labels.limit(0))) == brute(odd_rows, [])


def test_masks_of_the_text_filters():
    cases = ["", " \n", "A", "aaaa " * 50, "É" * 20 + "A", " ".join(f"w{i}" for i in range(50)), "a|b", "x" * 19 + "A", "x" * 20 + "A",
             " ".join("ab" for _ in range(60)), "\x1c".join(f"k{i}" for i in range(60))]
    for t in cases:
        want = sum(1 << "ABCD".index(f) for f in fails([(None, t)])[0])
        assert A.text_mask(t.encode(), len(t)) == want, t


def test_paths_of_the_lattice():
    forward, backward = A.path_counts(5)
    assert forward[31] == backward[0] == 120 and len(A.lattice_edges(5)) == 80
    for k in range(5):          # every step of every order is one edge
        assert sum(o for s, _, o in A.lattice_edges(5) if bin(s).count("1") == k) == 120
    steps = A.order_steps("ABCDE")
    assert len(steps) == 600 and {(s, b) for _, _, s, b in steps} == {(s, b) for s, b, _ in A.lattice_edges(5)}


def test_copies_of_one_text_are_no_hot_key(spark):
    """The join that finds later copies is dealt by digest and id."""
    rows = [(i, "same text", "en", "s", 1) for i in range(50)]
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = A.failures(spark.createDataFrame(rows, DOCS))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    one = {r.removed for r in A.audit(spark.createDataFrame(rows, DOCS), lab).filter("filter_order like 'E%' and step = 1").collect()}
    assert one == {49}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_shapley_of_fewer_filters(spark, n):
    """The lattice is general in the number of filters."""
    cell = spark.createDataFrame([("p", m, 10 + m, 0, 0) for m in range(1 << n)], "part string, mask int, documents long, good long, toxic long")
    e = A.edge_removals(cell, n).collect()
    for f in range(n):
        want = 0
        for order in itertools.permutations(range(n)):
            before = sum(1 << x for x in order[:order.index(f)])
            want += sum(10 + m for m in range(1 << n) if m >> f & 1 and not m & before)
        assert sum(r.orders * r.removed for r in e if r.bit == 1 << f) == want
