"""Each operator on documents against a brute-force version, and on odd rows."""
import collections
import hashlib
import math
import random
import re
import struct

import numpy as np
import public_tokenizers
import pytest
import xxhash
from llm_helpers import clash
from pyspark.sql import functions as F

from relmon.llm import (bpe_codec, compression_quality, exact_dedup, line_dedup, mixing, pii, quality_rules, simhash_dedup,
                        token_count)

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


# ---------------------------------------------------------------- odd rows, empty tables, clashing names

RUNS = {
    "pii": lambda d, lab: pii.find(d), "count": lambda d, lab: token_count.count_tokens(d, BYTE),
    "mixing": lambda d, lab: mixing.mixture_report(d), "lines": lambda d, lab: line_dedup.line_dedup(d),
    "codec": lambda d, lab: bpe_codec.codec_digests(d, WORD), "exact": lambda d, lab: exact_dedup.exact_dedup(d),
    "simhash": lambda d, lab: simhash_dedup.simhash_components(d),
    "compression": lambda d, lab: compression_quality.quality_scores(d, lab),
    "rules": lambda d, lab: quality_rules.quality_report(d, lab),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_rows_empty_tables_and_clashing_names(name, odd, none, labels):
    plain = RUNS[name](odd, labels)
    got = rows(plain)
    assert len(got) == odd.count()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    other = RUNS[name](clash(odd), labels)
    assert sorted(map(str, rows(other))) == sorted(map(str, got)) and other.columns == plain.columns
    assert rows(RUNS[name](none, labels)) == []
    if name in ("compression", "rules"):
        assert len(rows(RUNS[name](odd, labels.limit(0)))) == odd.count()


# ---------------------------------------------------------------- 1 personal data

def base_spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        g = re.sub(r"\D", "", m.group())
        odd_even = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(g))]
        if 14 <= len(g) <= 19 and sum(odd_even) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_pii_base_spans_and_additions(spark, texts):
    rnd = random.Random(3)
    odd = ["", "a@b.c_d@e.f", "a@b.c..d@e.f", "1.2.3.4.5.6.7.8 0255.0.1.1 256.1.1.1", "4111 1111 1111 1111", "4111  1111 1111 1111",
           "1 " * 3000, "1" * 20000, "+1 (974) 555-2485. +49 30 1234567+1", "é\U0001f600 a@b.co", "a." * 5000 + "@b.c",
           "a@b" + ".c" * 5000, "+1" + "(" * 3000, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" x"]
    odd += ["".join(rnd.choice("01234  --..++@@ab(_%4") for _ in range(rnd.randrange(60))) for _ in range(600)]
    odd += ["".join(rnd.choice("0123456789 -") for _ in range(rnd.randrange(40))) for _ in range(300)]
    every = {**{10**6 + i: t for i, t in enumerate(odd)}, **texts}
    got = {r["doc_id"]: r for r in rows(pii.find(spark.createDataFrame(list(every.items()), "doc_id long, text string")))}
    for i, t in every.items():
        want = base_spans(t)
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k + ":") for x in want) for k in pii.KINDS]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r["n_added"]
    assert any("secret:9:49" in r["spans"] for r in got.values())


def test_pii_em_finds_the_reliable_labelers():
    rnd = random.Random(1)
    table = collections.Counter()
    for _ in range(4000):
        y = rnd.random() < 0.4
        table["".join("+" if (y if rnd.random() < acc else not y) else "-" for acc in (0.95, 0.9, 0.55, 0.85, 0.5))] += 1
    post, rel, prior = pii.em(dict(table))
    good = [r["+"][0] + r["-"][1] for r in rel]
    assert min(good[0], good[1], good[3]) > max(good[2], good[4]) and abs(prior - 0.4) < 0.05
    assert post["+++++"] > 0.9 and post["-----"] < 0.1
    w = pii.train([("1" * 8, 0.95, 10.0), ("0" * 8, 0.05, 10.0)])
    assert pii.score(w, "1" * 8) > 0.5 > pii.score(w, "0" * 8)


# ---------------------------------------------------------------- 2 and 5 tokens

def strange_texts():
    rnd = random.Random(5)
    alpha = "abcdeé  \n\t'sßΣİ<|endoftext|>0123,.!日本語한́\U0001f600​\x1c\x85՘Ᲊ"
    return ["", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 3000, "'S 's 'LL I'll", "x<|endoftext|><|startoftext|>y"] + [
        "".join(rnd.choice(alpha) for _ in range(rnd.randrange(80))) for _ in range(500)]


def test_counts_are_those_of_the_library(texts):
    from tokenizers import Tokenizer
    lib, c = Tokenizer.from_file(BYTE), token_count.Counter(token_count.prove(BYTE))
    every = [*texts.values(), *strange_texts()]
    assert [c.count(t) for t in every] == [len(e.ids) for e in lib.encode_batch(every, add_special_tokens=False)]


def test_proved_strings_are_one_token():
    from tokenizers import Tokenizer
    whole = token_count.prove(BYTE)["whole"]
    lib = Tokenizer.from_file(BYTE)
    some = random.Random(2).sample(sorted(whole), 3000)
    assert {len(e.ids) for e in lib.encode_batch(some, add_special_tokens=False)} == {1} and len(whole) > 40_000


def test_codec_is_the_library_s_and_round_trips(spark, texts):
    from tokenizers import Tokenizer
    lib, c = Tokenizer.from_file(WORD), bpe_codec.Codec(WORD)
    rnd = random.Random(4)
    every = [*texts.values(), *strange_texts(), *["".join(rnd.choice("abcdefgh"[:rnd.choice([2, 4, 8])]) for _ in range(rnd.randrange(1, 30)))
                                                  for _ in range(3000)]]
    want = [e.ids for e in lib.encode_batch(every, add_special_tokens=False)]
    assert [c.encode(t) for t in every] == want
    assert [c.decode(i) for i in want] == [lib.decode(i, skip_special_tokens=False) for i in want]
    few = spark.createDataFrame([(i, t) for i, t in enumerate(every[:40])], "doc_id long, text string")
    enc = bpe_codec.encode_documents(few, WORD)
    assert {r.doc_id: r.token_ids for r in enc.collect()} == dict(enumerate(want[:40]))
    assert {r.doc_id: r.text for r in bpe_codec.decode_documents(enc, WORD).collect()} == {
        i: lib.decode(x, skip_special_tokens=False) for i, x in enumerate(want[:40])}
    dig = {r.doc_id: r for r in bpe_codec.codec_digests(few, WORD).collect()}
    assert dig[3].ids_sha256 == hashlib.sha256(" ".join(map(str, want[3])).encode()).hexdigest()


def test_long_pieces_merge_like_short_ones():
    from relmon.llm import bpe
    ranks = {("a", "b"): 1, ("ab", "a"): 2, ("b", "a"): 0, ("ba", "ba"): 3, ("a", "ba"): 4}
    rnd = random.Random(6)
    for _ in range(300):
        s = [rnd.choice("ab") for _ in range(rnd.randrange(2, 60))]
        assert bpe._merge_long(list(s), ranks) == bpe.merge(list(s), ranks)


# ---------------------------------------------------------------- 3 mixing

def test_mixing_repeats_small_sources_within_the_limit(spark, docs):
    got = rows(mixing.mixture_report(docs))
    tok, mixed = collections.Counter(), collections.Counter()
    for r in got:
        tok[r["source"]] += r["n_tokens"]
        mixed[r["source"]] += r["n_tokens"] * r["copies"]
        assert 1 <= r["copies"] <= 2
    assert abs(sum({r["source"]: r["weight"] for r in got}.values()) - 1) < 1e-6
    total = sum(tok.values())
    out = mixing.mix(docs.withColumn("extra", F.lit(1)))
    assert out.columns == [*docs.columns, "extra"]
    assert collections.Counter(r.doc_id for r in out.collect()) == {r["doc_id"]: r["copies"] for r in got}
    assert total <= sum(mixed.values()) <= 2 * total


def test_mixing_entropy_budget_and_tokenless_sources(spark):
    d = spark.createDataFrame([(i, "w " * (50 if i % 10 else 3), "big" if i % 10 else "small") for i in range(400)]
                              + [(1000, "", "empty"), (1001, "a b", None)], "doc_id long, text string, source string")
    equal = {r["source"]: r["weight"] for r in rows(mixing.mixture_report(d, target_entropy=np.log(3), repetition_limit=None))}
    assert equal["big"] == pytest.approx(1 / 3, abs=1e-5) and equal["empty"] == 0
    asis = {r["source"]: r["weight"] for r in rows(mixing.mixture_report(d, target_entropy=0.0, repetition_limit=None))}
    assert asis["big"] == pytest.approx(18000 / (18000 + 120 + 2), abs=1e-4)
    part = rows(mixing.mixture_report(d, target_entropy=0.0, repetition_limit=None, budget=9000))
    spent = sum(r["copies"] * r["n_tokens"] for r in part)
    assert 8000 < spent <= 9000
    assert [r["copies"] for r in part if r["source"] == "empty"] == [1]


# ---------------------------------------------------------------- 4 lines

def brute_lines(texts, min_docs=3, min_tokens=5, share=0.8):
    leaves = collections.defaultdict(list)
    for i, t in texts.items():
        for n, line in enumerate(t.split("\n")):
            k = tuple("<*>" if re.search("[0-9]", w) else w for w in words(line))
            if len(k) >= min_tokens:
                leaves[(len(k), *k[:3])].append((i, n, k))
    drop = set()
    for ls in leaves.values():
        docs_of = collections.defaultdict(set)
        for i, _, k in ls:
            docs_of[k].add(i)
        if len({x[0] for x in ls}) < min_docs:
            continue
        support = collections.Counter()
        for k, s in docs_of.items():
            for p, w in enumerate(k):
                support[p, w] += len(s)
        groups = collections.defaultdict(list)
        for i, n, k in ls:
            tpl = tuple(w if w != "<*>" and (p < 3 or support[p, w] >= min_docs) else None for p, w in enumerate(k))
            if sum(x is not None for x in tpl) >= share * len(k):
                groups[tpl].append((i, n))
        for at in groups.values():
            if len({x[0] for x in at}) >= min_docs:
                drop |= set(at) - {min(at)}
    return drop


def test_line_templates_against_brute_force(spark, texts):
    every = dict(texts)
    passage = " ".join(f"shared{chr(97 + i % 26)}{'abc'[i % 3]}" for i in range(60))
    for i in range(6):
        every[10_000 + i] = f"own {chr(97 + i) * 3} {chr(97 + i) * 2} words here\nLogin of user {i * 7} from host {i}.example was fine today\n{passage}"
    drop = brute_lines(every)
    assert (10_003, 1) in drop and (10_003, 2) in drop and (10_000, 2) not in drop and (10_003, 0) not in drop
    for r in rows(line_dedup.line_dedup(spark.createDataFrame(list(every.items()), "doc_id long, text string"))):
        ls = every[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for n, x in enumerate(ls) if (r["doc_id"], n) not in drop)
        assert r["n_dropped"] == sum((r["doc_id"], n) in drop for n in range(len(ls))) and r["n_lines"] == len(ls)


# ---------------------------------------------------------------- 6 and 7 duplicates

def test_exact_groups_and_heavy_hitters(spark, odd, odd_rows):
    d = odd.unionByName(spark.createDataFrame([(100 + i, "hot text", "en", "s", 1) for i in range(500)], odd.schema)
                        ).unionByName(spark.createDataFrame([(50, "hot  text ", "en", "s", 1)], odd.schema))
    for counters in (16, 2048):        # with and without heavy groups
        got = rows(exact_dedup.exact_dedup(d, counters=counters))
        hot = [r for r in got if r["group_size"] == 501]
        assert len(hot) == 501 and {r["keep_id"] for r in hot} == {50} and sum(r["kept"] for r in hot) == 1
        by = {r["doc_id"]: r for r in got}
        assert by[9]["keep_id"] == 2 and by[1]["group_size"] == 4 and by[4]["keep_id"] == 5
        assert by[1]["text_sha256"] == hashlib.sha256(b"alphabetagammadelta").hexdigest()
    left = exact_dedup.dedup(clash(d))
    assert left.columns == clash(d).columns
    assert collections.Counter(r.doc_id for r in left.collect()) == {2: 1, 5: 1, None: 1, 6: 1, 7: 1, 8: 1, 50: 1}


def brute_fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh)) if sh else 0


def brute_components(fps, limit=3):
    ids, a = list(fps), np.array(list(fps.values()), dtype=np.uint64)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for n, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[n]) <= limit):
            x, y = root(i), root(ids[j])
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_against_brute_force(spark, texts):
    every = dict(texts)
    rnd = random.Random(9)
    long = [f"word{rnd.randrange(500)}" for _ in range(900)]
    for i in range(60):
        w = list(long)
        w[rnd.randrange(len(w))] = f"other{i}"
        every[20_000 + i] = " ".join(w)
    every[30_000], every[30_001], every[30_002] = "", "one", "One"
    fps = {i: brute_fingerprint(t) for i, t in every.items()}
    comp = brute_components(fps)
    got = rows(simhash_dedup.simhash_components(spark.createDataFrame(list(every.items()), "doc_id long, text string")))
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert len({comp[20_000 + i] for i in range(60)}) < 30


def test_links_keep_every_component_of_random_fingerprints(spark):
    rnd = random.Random(11)
    vals = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 25)):
            vals.add(x)
            for b in rnd.sample(range(64), rnd.randrange(1, 5)):
                x ^= 1 << b
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(vals)]
    got = simhash_dedup.components(simhash_dedup.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    root = {r.fp: r.root for r in got.collect()}
    want = brute_components({v: v & (1 << 64) - 1 for v in signed})
    for a in signed:
        assert (a in root) == any(want[a] == want[b] for b in signed if b != a)
    groups = collections.defaultdict(set)
    for v, r in root.items():
        groups[r].add(v)
    assert {frozenset(g) for g in groups.values()} == {
        frozenset(b for b in signed if want[b] == want[a]) for a in root}


@pytest.mark.parametrize("homes,most", [(8, 1 << 15), (8, 16), (1 << 12, 5)])
def test_large_runs_and_cells_lose_no_link(spark, monkeypatch, homes, most):
    monkeypatch.setattr(simhash_dedup, "CELL_HOMES", homes)
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", most)
    rnd = random.Random(12)
    near = {0x5555} | {0x5555 ^ 1 << a ^ 1 << b for a in range(40) for b in range(a)}
    key, fp = np.zeros(len(near), dtype=np.int64), np.array(sorted(near), dtype=np.int64)
    home = np.ones(len(near), dtype=bool)
    assert len(simhash_dedup._runs(key, fp, home, 3)) == len(near) - 1
    some = rnd.sample(sorted(near), 120)
    got = {r.fp: r.root for r in simhash_dedup.components(
        simhash_dedup.links(spark.createDataFrame([(v,) for v in some], "fp long"))).collect()}
    want = brute_components({v: v for v in sorted(some)})
    assert {v: got.get(v, v) for v in some} == want


def test_cells_of_a_hot_anchor_are_bounded_and_meet_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL_HOMES", 16)
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", 32)
    rows_ = [(1, f, f % 3 > 0) for f in range(300)] + [(2, f, False) for f in range(200)] + [(3, f, True) for f in range(9)]
    got = rows(simhash_dedup.salted(spark.createDataFrame(rows_, "key long, fp long, home boolean")))
    cells = collections.defaultdict(list)
    for r in got:
        cells[r["key"], r["salt"]].append((r["fp"], r["home"]))
    for key, all_ in ((1, 300), (3, 9)):
        met = collections.Counter((a, b) for (k, _), c in cells.items() if k == key for a, h in c if h for b, _ in c if a != b)
        own = [f for k, f, h in rows_ if k == key and h]
        assert all(met[a, b] for a in own for b in range(all_) if a != b)
    # homes of one row of the grid, and what comes to a column, with some spread
    assert max(sum(h for _, h in c) for c in cells.values()) <= 32 and max(len(c) for (k, _), c in cells.items() if k == 1) <= 96
    assert all(len({f for f, _ in c}) == len(c) for c in cells.values())
    assert {s for k, s in cells if k == 3} == {0}


def test_frequent_fingerprints_do_not_change_the_result(spark, monkeypatch):
    rows_ = [(i, "the same few words here") for i in range(400)] + [(1000 + i, f"text number {i} stands alone {i * i}") for i in range(30)] + [(None, "the same few words here")]
    d = spark.createDataFrame(rows_, "doc_id long, text string")
    got = sorted(map(str, rows(simhash_dedup.simhash_components(d))))
    monkeypatch.setattr(simhash_dedup, "COUNTERS", 2)
    assert sorted(map(str, rows(simhash_dedup.simhash_components(d)))) == got and len(got) == 431
    assert sum("'component_id': 0}" in x for x in got) == 401


def test_near_dedup_keeps_the_smallest_id_once(spark, odd):
    left = simhash_dedup.near_dedup(odd)
    assert left.columns == odd.columns
    ids = collections.Counter(r.doc_id for r in left.collect())
    assert max(ids.values()) == 1 and 1 in ids and 2 not in ids and 3 in ids and 4 not in ids


# ---------------------------------------------------------------- 9 and 10 quality

def junk_and_prose(n=400):
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(60, 200))]
        bad = i % 5 == 0
        out.append((i, " ".join(x.upper() + "!!" for x in w) if bad and i % 2 else " ".join(x + "%%%" for x in w) if bad else
                    " ".join(w) + ".", 0 if bad else 1))
    return out


def test_compression_classifier_on_held_out_documents(spark):
    data = junk_and_prose()
    d = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    lab = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(compression_quality.quality_scores(d, lab))}
    import zlib
    held = [(got[i], q) for i, _, q in data if got[i]["held_out"]]
    assert {i for i in got if got[i]["held_out"]} == {i for i in got if zlib.crc32(str(i).encode()) % 3 == 1}
    good, bad = [r["score"] for r, q in held if q], [r["score"] for r, q in held if not q]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.95
    # labels of held-out rows are never read
    flipped = spark.createDataFrame([(i, 1 - q if got[i]["held_out"] else q, 0) for i, _, q in data], lab.schema)
    again = {r["doc_id"]: r["score"] for r in rows(compression_quality.quality_scores(d, flipped))}
    assert again == {i: r["score"] for i, r in got.items()}


def brute_rules(t):
    w = words(t)
    n = len(w)
    seen = collections.Counter(tuple(w[i:i + 8]) for i in range(n - 7))
    covered = {i + k for i in range(n - 7) if seen[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def test_quality_rules_against_brute_force(spark, texts, sf):
    every = dict(texts)
    every |= {40_000: "a b c d e f g h " * 5, 40_001: "x " * 30, 40_002: "l\nl\n \n\nl\tl " + "z " * 25, 40_003: "# * $ % & | < >" * 4}
    d = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = rows(quality_rules.quality_report(d, spark.read.parquet(f"{sf}/labels.parquet")))
    assert len(got) == len(every)
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == \
            brute_rules(every[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def brute_ratio(texts, good, buckets=1 << 16, prior=0.5, rejected=0.001):
    """Ratio and verdict of every text by the words of the module's docstring, in plain Python."""
    def xx(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def signed(n):
        return n - (1 << 64) if n >= 1 << 63 else n

    def grams(t):
        h = [xx(w.encode()) | 1 for w in words(t)]
        pairs = [xx(struct.pack("<Q", y), xx(struct.pack("<Q", x))) & ~1 for x, y in zip(h, h[1:])]
        return [g % (2 * buckets) for g in h + pairs]

    def fold(i):
        return xx(struct.pack("<q", i), xx(b"fold")) & 1
    of = {i: grams(t) for i, t in texts.items()}
    raw = collections.Counter(g for gs in of.values() for g in gs)
    sums = [sum(n for g, n in raw.items() if g % 2 == k) for k in (0, 1)]
    llr = {}
    for f in (0, 1):        # the model of fold f comes from the trusted documents of the other one
        seen = collections.Counter(g for i in good if fold(i) != f for g in of[i])
        n = [sum(c for g, c in seen.items() if g % 2 == k) for k in (0, 1)]
        for i, gs in of.items():
            if fold(i) == f:
                each = [0.0 if not n[g % 2] else math.log((seen[g] / n[g % 2] / (raw[g] / sums[g % 2]) + prior) / (1 + prior)) for g in gs]
                llr[i] = sum(each) / len(each) if each else 0.0
    low = [llr[i] for i in good if len(words(texts[i])) >= 20]
    least = np.quantile(low, rejected) if low else float("-inf")
    return {i: (llr[i], llr[i] >= least and not brute_rules(texts[i])[-1]) for i in texts}


def test_ratio_separates_junk_from_prose_and_is_the_formula(spark):
    data = junk_and_prose()
    texts = {i: t for i, t, _ in data} | {90_001: "", 90_002: "one", 90_003: None or " "}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lab = spark.createDataFrame([(i, q, 0) for i, _, q in data if i % 2], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality_rules.quality_report(d, lab))}
    assert np.mean([got[i]["kept"] for i, _, q in data if q]) > 0.97
    assert not any(got[i]["kept"] for i, _, q in data if not q)
    want = brute_ratio(texts, [i for i, _, q in data if i % 2 and q])
    for i, (llr, kept) in want.items():
        assert got[i]["llr"] == pytest.approx(llr, abs=1e-9) and got[i]["kept"] == kept, i


@pytest.fixture(scope="module")
def many_trusted(spark):
    """More than 20,000 trusted documents, and 300 others, of which 100 have no id."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("aeioulnrst") for _ in range(4)) for _ in range(500)]
    texts = {i: " ".join(rnd.choices(vocab, k=24)) for i in range(20_700)} | {i: f"odd{i} " * 3 + " ".join(rnd.choices(vocab, k=20)) for i in range(20_700, 20_900)}
    d = spark.createDataFrame([(i if i < 20_800 else None, t) for i, t in texts.items()], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 20_600), 0) for i in range(20_700)], "doc_id long, quality int, toxic int")
    return texts, d, lab, brute_ratio(texts, range(20_600))


def test_models_and_threshold_come_from_all_trusted_documents(many_trusted):
    _, d, lab, want = many_trusted
    assert quality_rules.trusted_ids(lab).count() == 20_600
    got = rows(quality_rules.quality_report(d, lab))
    assert len(got) == d.count() and sum(r["doc_id"] is None for r in got) == 100
    for r in got:
        if r["doc_id"] is not None:
            llr, kept = want[r["doc_id"]]
            assert r["llr"] == pytest.approx(llr, abs=1e-9) and r["kept"] == kept


def test_low_quantile_is_the_percentile(spark):
    for n, parts in ((1, 1), (2, 2), (1001, 3), (5003, 5), (60_000, 4)):
        v = spark.range(0, n, numPartitions=parts).select((F.xxhash64("id") % 5000 / 7).alias("llr"))
        for share in (0.001, 0.25, 1.0):
            assert quality_rules._low_quantile(v, share) == v.agg(F.percentile("llr", F.lit(share))).first()[0]
    assert quality_rules._low_quantile(v.limit(0), 0.001) is None


def test_buckets_follow_the_corpus(spark, monkeypatch):
    d = spark.createDataFrame([(1, "word " * 1000), (2, None)], "doc_id long, text string")
    least, most = quality_rules.MIN_BUCKETS, quality_rules.MAX_BUCKETS
    assert quality_rules.bucket_count(d) == least and quality_rules.bucket_count(d.limit(0)) == least
    monkeypatch.setattr(quality_rules, "CHARS_PER_BUCKET", 1)
    many = spark.range(4 * least // 1024).select(F.repeat(F.lit("x"), 1024).alias("text"))
    assert quality_rules.bucket_count(many) == 4 * least
    assert quality_rules.bucket_count(spark.range(64).select(F.repeat(F.lit("x"), most // 32).alias("text"))) == most


def test_model_is_not_copied_into_rows(spark, odd, labels):
    plan = quality_rules.quality_filter(odd, labels)._jdf.queryExecution().executedPlan().toString()
    assert "array(CASE WHEN" in plan and "array(__m" not in plan


def test_filter_takes_its_threshold_from_all_trusted_documents(many_trusted):
    _, d, lab, want = many_trusted
    kept = {r["doc_id"] for r in rows(quality_rules.quality_filter(d, lab))} - {None}
    assert kept == {i for i, (_, k) in want.items() if k and i < 20_800}
