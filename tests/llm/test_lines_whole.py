"""Lines that the registered query drops beyond the limits of the plain call."""
import collections
import random
import re

import xxhash
from llm_helpers import clash

from relmon.llm import line_dedup


def left(spark, texts):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_dedup.line_dedup(d, **line_dedup.WHOLE).collect()}


def test_equal_lines_of_two_documents(spark):
    passage = " ".join(f"word{'abcdefghij'[i % 10]}{'xyz'[i % 3]}" for i in range(55))
    got = left(spark, {1: f"one own line of words\n{passage}", 2: f"{passage}\nanother own line of words\n{passage}",
                       3: "the code 1234 is for you", 4: "the code 1234 is for you", 5: "the code 9999 is for you two",
                       6: "the code 8888 is for you two", 7: "said twice in one document\nsaid twice in one document"})
    assert got[1] == f"one own line of words\n{passage}" and got[2] == "another own line of words"
    assert got[3] == "the code 1234 is for you" and got[4] == ""
    assert got[5] and got[6] and got[7] == "said twice in one document\nsaid twice in one document"


def test_short_lines_need_three_documents(spark):
    got = left(spark, {i: f"All rights reserved.\n\nEnd\nown{'abcdef'[i]}" + ("\nonly two" if i < 2 else "") for i in range(6)})
    assert got[0] == "All rights reserved.\n\nEnd\nowna\nonly two"
    assert got[1] == "\nownb\nonly two" and got[5] == "\nownf"


def test_templates_with_several_variable_fields(spark):
    rare = ["".join("abcdefghij"[int(c)] for c in f"{i:03d}") for i in range(120)]
    texts = {i: f"own{rare[i]}\nPosted on 2021-03-{i:02d} at 12:{i:02d} by admin\nLogin u{i} from 10.0.0.{i} at 12:{i:02d}\nPage {i} of {i + 9}"
             for i in range(12)}
    texts |= {100 + i: f"It was a {r} {r}x {r}y {r}z" for i, r in enumerate(rare)}    # prose that starts alike
    texts |= {300 + i: f"Job {i} state {r} host {r}x user {r}y zone {r}z" for i, r in enumerate(rare)}    # 5 of 10 at most
    texts |= {500 + i: f"Seen {i} by {r} {r}x {r}y {r}z until {r}w {r}v today" for i, r in enumerate(rare)}    # 4 of 10
    got = left(spark, texts)
    assert all(got[i] == texts[i] for i in [0, *range(100, 220), 300, 500])
    assert all(got[i] == f"own{rare[i]}" for i in range(1, 12))
    assert not any(got[i] for i in [*range(301, 420), *range(501, 620)])


def brute_whole(rows, min_docs=3, share=0.8, exact_docs=2, exact_tokens=5, by_support=line_dedup.BY_SUPPORT):
    """The registered limits in plain Python; a document is (id, text), and what goes (document, line)."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is None, d[0] or 0, th(d[1])))
    order = {d: k for k, d in enumerate(docs)}
    raw, leaves = collections.defaultdict(list), collections.defaultdict(list)
    for d in docs:
        for n, line in enumerate(d[1].split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line)
            if w:
                raw[tuple(w)].append((order[d], n))
                k = tuple("<*>" if re.search("[0-9]", x) else x for x in w)
                leaves[len(k), *k[:3]].append((order[d], n, k))
    drop = set()
    for w, at in raw.items():
        if len({d for d, _ in at}) >= (exact_docs if len(w) >= exact_tokens else min_docs):
            drop |= set(at) - {min(at)}
    for ls in leaves.values():
        if len({x[0] for x in ls}) < min_docs:
            continue
        docs_of = collections.defaultdict(set)
        for d, _, k in ls:
            docs_of[k].add(d)
        support = collections.Counter()
        for k, s in docs_of.items():
            for p, x in enumerate(k):
                support[p, x] += len(s)
        groups, needs = collections.defaultdict(list), {}
        for d, n, k in ls:
            const = [p for p, x in enumerate(k) if x != "<*>" and support[p, x] >= min_docs]
            n_const, tail = len(const), sum(p >= 3 for p in const)
            need = None
            if n_const >= share * len(k):
                need = min_docs
            else:
                for many, part, least in by_support:
                    guard = tail >= min(least, max(len(k) - 3, 0))
                    if n_const >= part * len(k) and (guard or (part > 0 and n_const - tail < min(len(k), 3))):
                        need = many
                        break
            if need is not None:
                tpl = tuple((p, k[p]) for p in const)
                groups[tpl].append((d, n))
                needs[tpl] = max(needs.get(tpl, 0), need)
        for tpl, at in groups.items():
            if len({d for d, _ in at}) >= needs[tpl]:
                drop |= set(at) - {min(at)}
    out = []
    for i, t in rows:
        d = order[i, t or ""]
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if (d, n) not in drop]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def th(text):
    n = xxhash.xxh64_intdigest(text.encode(), 42)
    return n - (1 << 64) if n >= 1 << 63 else n


def whole(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(d.repartition(3), **line_dedup.WHOLE).collect()), key=str)


def test_registered_limits_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rnd = random.Random(8)
    some = ["Posted on {a} at {b} by admin", "Login {a} from host {b}", "Page {a} of {b}", "All rights reserved.", "It was a {w} day in {v}",
            "same long line of seven words here", "see {w}", "tab\there and\x0bthere {w} {w}  twice  spaced", "<*> is no field {w}"]
    for i in range(160):
        lines = [rnd.choice(some).format(a=rnd.randrange(10 ** 6), b=f"x{i}", w=rnd.choice("abcdef"), v="".join(rnd.choices("ghij", k=6)))
                 for _ in range(rnd.randrange(0, 6))]
        rows.append((rnd.choice([None, 10_000 + i, 10_000 + i, 10_007]), "\n".join(lines)))
    rows += rows[-30:]
    assert whole(spark, rows) == brute_whole(rows)


def test_documents_are_told_apart_by_their_text(spark):
    """Rows of one id, or of none, with different texts: what goes from one stays in the others."""
    dup = "this line of seven words comes again"
    rows = [(0, f"first\n{dup}"), (1, f"one\n{dup}"), (1, "two\nunique other text that must stay"), (None, dup), (None, "no other row has this line"),
            (None, f"three\n{dup}"), (2, f"{dup}\nlast"), (2, f"{dup}\nlast"), (3, None), (4, "")]
    got = whole(spark, rows)
    assert got == brute_whole(rows)
    texts = [(i, t) for i, t, _, _ in got]
    assert (1, "two\nunique other text that must stay") in texts and (None, "no other row has this line") in texts
    assert texts.count((2, "last")) == 2 and (None, "three") in texts and (None, "") in texts and (0, f"first\n{dup}") in texts


def test_odd_rows_at_the_registered_limits(spark, odd, odd_rows, none):
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(odd, **line_dedup.WHOLE).collect()), key=str)
    assert got == brute_whole([(r[0], r[1]) for r in odd_rows])
    assert sorted(map(str, line_dedup.line_dedup(clash(odd), **line_dedup.WHOLE).collect())) == \
        sorted(map(str, line_dedup.line_dedup(odd, **line_dedup.WHOLE).collect()))
    assert line_dedup.line_dedup(none, **line_dedup.WHOLE).collect() == []


def test_more_hot_leaves_than_the_bitmap_holds(spark, monkeypatch):
    rows = [(i, "\n".join(f"leaf {chr(97 + j)} of several documents {i}" for j in range(9))) for i in range(4)]
    want = whole(spark, rows)
    monkeypatch.setattr(line_dedup, "MIN_BITS", 0)
    assert whole(spark, rows) == want
    monkeypatch.setattr(line_dedup, "MAX_BITS", 1)
    assert whole(spark, rows) == want == brute_whole(rows)


def test_a_long_word_beside_a_digit(spark):
    rows = [(i, "x" * 300_000 + f" and {i}") for i in range(3)]
    assert whole(spark, rows) == brute_whole(rows)
