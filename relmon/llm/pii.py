"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and checks and
always stay.  Around them looser patterns propose further candidates.  Every
candidate gets votes of labelers - strict patterns, gazetteers, context words,
boundaries and shape - each for, against or abstaining.  Counting candidates
by kind, votes and features gives a table whose size is bounded by the number
of combinations, whatever the corpus; on it expectation-maximisation estimates
the labelers' reliabilities and each combination's posterior, and a logistic
span classifier for each kind is trained on the posteriors.  Candidates that
it accepts, and that overlap no base span, are added.

Everything that touches texts is DataFrame expressions, row by row: no
shuffle but that of the small table.  Java's matcher recurses for a repeated
group, so the patterns repeat single characters only: separators (or dots)
that touch another one, which end a match, are first replaced by a character
that does the same, one for one, so offsets stay.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.llm.common import whole_text

# The listed kinds in their order; kinds that the method adds come after them.
KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("id", "secret")
ORDER = {k: i for i, k in enumerate(KINDS + ADDED_KINDS)}

# Gazetteers and cue words of the labelers.
DOMAINS = "com org net edu gov int mil io info biz eu de fr es it nl uk us ca au jp in br ch at be se no pl".split()
COUNTRY_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 81 82 86 91".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|36|6011|65|35)"
RESERVED_NETS = r"^(?:0|10|127|169\.254|192\.168|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
KEY_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-|AIza|glpat-)"
CUES = (r"(?i)\b(?:e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|account|iban|ip|host|server|"
        r"pass(?:word|wd)?|pwd|token|secret|key|apikey|ssn|social)\b[^\n]{0,12}$")
COUNTER_CUES = r"(?i)\b(?:version|isbn|issn|doi|page|figure|table|section|http|https|www|build|rev|sha|md5|commit)\b[^\n]{0,12}$"

_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9-]"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]{12,}[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# 3-3-4, then numbers with a trunk zero, then any groups
LOOSE_PHONE = (r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|"
               r"\(?0[1-9][0-9]{0,4}\)?[ ./-]{0,1}[0-9]{2,8}(?:[ .-][0-9]{2,4}){0,4}|"
               r"\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,4}){2,4})(?![0-9])")
NATIONAL = (r"^(?:\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}|\(?0[1-9].*|"
            r"[6-9][0-9]{2}[ .-](?:[0-9]{3}[ .-][0-9]{3}|[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}))$")
LOOSE_EMAIL = (r"(?<![A-Za-z0-9])[A-Za-z0-9_]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}"
               r" ?[\[(]dot[\])] ?[A-Za-z]{2,16}(?![A-Za-z0-9])")
ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+(?!@|\.++[A-Za-z0-9_/+@-])"

VOTES = 5
FEATURES = 8
BEFORE = 32
CHUNK = 256         # elements of a chunk of a running total
SPAN = "struct<start:int,`end`:int,s:string,before:string,after:string>"


def _bound(c: Column, f) -> Column:
    """f(c) with ``c`` evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _scan(a: Column, op) -> Column:
    """Running totals of an array of ints by an associative ``op``: within chunks,
    over the chunks' totals, then both together.  An aggregate that grows its result
    copies it at every step; here no copy is longer than a chunk or the number of chunks."""
    def small(x: Column) -> Column:
        none = F.lit(None).cast("int")

        def step(acc: Column, v: Column) -> Column:
            t = F.when(acc["t"].isNull(), v).otherwise(op(acc["t"], v))
            return F.struct(t.alias("t"), F.concat(acc["out"], F.array(t)).alias("out"))
        return F.aggregate(x, F.struct(none.alias("t"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def large(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int"))
        inner = F.transform(at, lambda k: small(F.slice(x, k * CHUNK + 1, F.lit(CHUNK))))

        def joined(c: Column) -> Column:
            return _bound(small(F.transform(c, lambda y: F.element_at(y, -1))), lambda t: F.flatten(F.transform(
                c, lambda y, k: F.when(k == 0, y).otherwise(F.transform(y, lambda v: op(F.get(t, k - 1), v))))))
        return _bound(inner, joined)
    return _bound(a, lambda x: F.when(F.size(x) <= CHUNK, small(x)).otherwise(large(x)))


def _found(text: Column, pattern: str) -> Column:
    """Matches with offsets: running sums of the lengths of the pieces between the
    matches and of the matches."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(x: Column) -> Column:
        p, h = x["p"], x["h"]
        ends = _scan(F.transform(h, lambda s, i: F.length(F.get(p, i)) + F.length(s)), lambda t, v: t + v)
        return _bound(ends, lambda e: F.transform(h, lambda s, i: F.struct(
            (F.get(e, i) - F.length(s)).alias("start"), F.get(e, i).alias("end"), s.alias("s"),
            F.substring(F.get(p, i), -BEFORE, BEFORE).alias("before"), F.substring(F.get(p, i + 1), 1, 1).alias("after"))))
    none = F.array().cast(f"array<{SPAN}>")
    # both arrays are bound once; most texts have no match
    return _bound(F.struct(pieces.alias("p"), hits.alias("h")), lambda x: F.when(F.size(x["h"]) > 0, spans(x)).otherwise(none))


def _apart(more: Column, base: Column) -> Column:
    """The candidates that overlap no base span.  Base spans at their start and
    candidates at their end in one order: a candidate is met by those that began
    before its end, and overlaps one of them if the furthest end among them is
    beyond its start."""
    def meet(x: Column) -> Column:
        b, m = x["b"], x["m"]
        starts = F.transform(b, lambda y: F.struct(y["start"].alias("at"), F.lit(1).alias("o"), y["end"].alias("end"), F.lit(-1).alias("i")))
        ends = F.transform(m, lambda y, i: F.struct(y["end"].alias("at"), F.lit(0).alias("o"), F.lit(-1).alias("end"), i.alias("i")))

        def told(e: Column) -> Column:
            reach = _scan(F.transform(e, lambda y: y["end"]), lambda t, v: F.greatest(t, v))
            # the furthest end before each candidate, back in the candidates' order
            seen = _bound(reach, lambda r: F.array_sort(F.filter(F.transform(e, lambda y, k: F.struct(y["i"].alias("i"), F.get(r, k).alias("r"))),
                                                                 lambda z: z["i"] >= 0)))
            return _bound(seen, lambda z: F.filter(m, lambda y, i: F.get(z, i)["r"] <= y["start"]))
        return _bound(F.array_sort(F.concat(starts, ends)), told)
    return _bound(F.struct(base.alias("b"), more.alias("m")),
                  lambda x: F.when((F.size(x["b"]) > 0) & (F.size(x["m"]) > 0), meet(x)).otherwise(x["m"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _byte(p: Column) -> Column:
    z = F.ltrim(p, F.lit("0"))
    return (F.length(z) < 3) | ((F.length(z) == 3) & (z <= "255"))


def _luhn(d: Column) -> Column:
    """Of a string of digits; every second digit from the right is doubled."""
    def step(s: Column, i: Column) -> Column:
        v = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        v = F.when(i % 2 == 1, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))
        return s + v
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each listed kind its spans.  A text that lacks a character that every
    match needs is not searched."""
    none = F.array().cast(f"array<{SPAN}>")
    digit = text.rlike("[0-9]")
    email = _found(F.regexp_replace(text, r"(?<=\.)\.|\.(?=\.)", "_"), EMAIL)
    ip = F.filter(_found(text, IP), lambda x: F.forall(F.split(x["s"], r"\."), _byte))
    # the length first: the sum is for plausible numbers only
    n = lambda x: F.length(_digits(x["s"]))
    card = F.filter(F.filter(_found(F.regexp_replace(text, r"(?<=[ -])[ -]|[ -](?=[ -])", "\n"), CARD),
                             lambda x: n(x).between(14, 19)), lambda x: _luhn(_digits(x["s"])))
    phone = F.filter(_found(text, PHONE), lambda x: n(x).between(10, 15))
    return {"email": F.when(text.contains("@"), email).otherwise(none),
            "ip": F.when(digit, ip).otherwise(none), "card": F.when(digit, card).otherwise(none),
            "phone": F.when(text.contains("+"), phone).otherwise(none)}


def loose_spans(text: Column) -> dict[str, Column]:
    """Further candidates of each kind."""
    none = F.array().cast(f"array<{SPAN}>")
    digit = text.rlike("[0-9]")
    secret = F.filter(_found(text, SECRET), lambda x: x["s"].rlike("[0-9]") & x["s"].rlike("[A-Za-z]"))
    return {"email": F.when(text.rlike(r"[\[(]at[\])]"), _found(text, LOOSE_EMAIL)).otherwise(none),
            "phone": F.when(digit, F.filter(_found(text, LOOSE_PHONE), lambda x: F.length(_digits(x["s"])).between(9, 13))).otherwise(none),
            "id": F.when(digit, _found(text, ID)).otherwise(none),
            "secret": F.when(digit, secret).otherwise(none)}


def _votes(kind: str, strict: bool, x: Column) -> list[Column]:
    """For, against or abstaining (1, -1, 0): strict pattern, gazetteer,
    context, boundary, shape."""
    s = x["s"]
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    if strict:
        pattern = F.lit(1)
    else:
        pattern = {"email": F.lit(0), "phone": vote(s.rlike(NATIONAL), s.rlike("[0-9]")),
                   "id": vote(~s.rlike(r"^(?:000|666|9)|-00-|-0000$"), s.rlike("[0-9]")),
                   "secret": vote(s.rlike(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,})$"), s.rlike("^[A-Za-z]+[0-9]{1,4}$"))}[kind]
    gazetteer = {
        "email": vote(s.rlike(r"(?i)(?:\.|dot[\])] ?)(?:" + "|".join(DOMAINS) + ")$"), F.lit(True)),
        "ip": vote(~s.rlike(RESERVED_NETS), F.lit(True)),
        "card": vote(s.rlike(ISSUERS), F.lit(True)),
        "phone": vote(s.rlike(r"^\+(?:" + "|".join(COUNTRY_CODES) + ")"), s.startswith("+")),
        "id": F.lit(0),
        "secret": vote(s.rlike(KEY_PREFIXES), s.rlike(r"^[A-Za-z]+(?:[-_/][A-Za-z0-9]+){2,}$")),
    }[kind]
    context = vote(x["before"].rlike(CUES), x["before"].rlike(COUNTER_CUES))
    boundary = vote(~x["before"].rlike("[A-Za-z0-9]$") & ~x["after"].rlike("^[A-Za-z0-9]"), F.lit(True))
    n = F.length(_digits(s))
    distinct = F.size(F.array_distinct(F.split(s, "")))
    shape = {"email": vote(F.length(s).between(6, 64), F.lit(True)), "ip": vote(F.length(s) <= 15, F.lit(True)),
             "card": vote(n.isin(14, 15, 16), F.lit(True)), "phone": vote(n.between(9, 13), F.lit(True)),
             "id": vote(distinct > 4, F.lit(True)),
             "secret": vote((distinct * 3 > F.length(s)) | (distinct > 8), F.lit(True))}[kind]
    return [pattern, gazetteer, context, boundary, shape]


def _candidate(kind: str, strict: bool, x: Column) -> Column:
    """start, end, kind, strict, votes as a string, features as a string."""
    v = _votes(kind, strict, x)
    s = x["s"]
    features = [v[0] == 1, v[1] == 1, v[1] == -1, v[2] == 1, v[2] == -1, v[3] == 1, v[4] == 1, s.rlike(r"[ ()\[\].-]")]
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(strict).alias("strict"),
                    F.concat(*[F.when(c == 1, "+").when(c == -1, "-").otherwise("0") for c in v]).alias("votes"),
                    F.concat(*[F.when(c, "1").otherwise("0") for c in features]).alias("features"))


def with_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base (spans of the listed kinds) and more (other candidates),
    each an array of candidates."""
    d = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("x"))
    none = F.array(_candidate("id", False, F.get(F.array().cast(f"array<{SPAN}>"), F.lit(0))))
    empty = F.slice(none, 1, 0)
    each = lambda a, kind, strict: F.transform(a, lambda x: _candidate(kind, strict, x))
    base = F.concat(*[each(a, k, True) for k, a in base_spans(F.col("x")).items()])
    more = F.concat(*[each(a, k, False) for k, a in loose_spans(F.col("x")).items()])
    any_ = F.col("x").rlike(r"[0-9@]|[\[(]at[\])]")
    d = d.select("doc_id", F.when(any_, base).otherwise(empty).alias("base"), F.when(any_, more).otherwise(empty).alias("more"))
    return d.select("doc_id", "base", _apart(F.col("more"), F.col("base")).alias("more"))


# ---------------------------------------------------------------- model (on the table of combinations)

def em(table: dict[str, float], rounds: int = 50) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]], float]:
    """Posterior of each vote combination, reliabilities, prior.  table: the
    count of each combination.  Labelers are taken as independent given the
    truth; the start is the majority, and a weak prior keeps every labeler
    better than chance and every probability off 0."""
    post = {v: min(0.95, max(0.05, 0.5 + 0.2 * (v.count("+") - v.count("-")))) for v in table}
    reliability: list[dict[str, tuple[float, float]]] = []
    prior = 0.5
    for _ in range(rounds):
        total = sum(table.values())
        prior = (sum(n * post[v] for v, n in table.items()) + 1) / (total + 2)
        reliability = []
        for k in range(VOTES):
            # pseudo-counts: right in 4 of 5 votes
            yes = {"+": 4.0, "-": 1.0, "0": 5.0}
            no = {"+": 1.0, "-": 4.0, "0": 5.0}
            for v, n in table.items():
                yes[v[k]] += n * post[v]
                no[v[k]] += n * (1 - post[v])
            sy, sn = sum(yes.values()), sum(no.values())
            reliability.append({c: (yes[c] / sy, no[c] / sn) for c in "+-0"})
        new = {}
        for v in table:
            odds = math.log(prior / (1 - prior)) + sum(math.log(r[c][0] / r[c][1]) for r, c in zip(reliability, v))
            new[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        change = max((abs(new[v] - post[v]) for v in table), default=0.0)
        post = new
        if change < 1e-9:
            break
    return post, reliability, prior


def train(rows: list[tuple[str, float, float]], rounds: int = 500, rate: float = 1.0, ridge: float = 1e-2) -> list[float]:
    """Weights (offset last) of a logistic classifier over feature strings.
    rows: features, soft label, count."""
    w = [0.0] * (FEATURES + 1)
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        g = [ridge * x for x in w]
        g[-1] = 0.0
        for f, y, n in rows:
            p = score(w, f)
            e = (p - y) * n / total
            for k, c in enumerate(f):
                if c == "1":
                    g[k] += e
            g[-1] += e
        w = [a - rate * b for a, b in zip(w, g)]
    return w


def score(w: list[float], features: str) -> float:
    z = w[-1] + sum(a for a, c in zip(w, features) if c == "1")
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(candidates: DataFrame) -> dict[str, list[float]]:
    """A classifier for each kind.  What is collected is one row for each
    combination of kind, votes and features: its number is bounded by the
    combinations of the labelers, not by the corpus."""
    each = candidates.select(F.explode(F.concat("base", "more")).alias("c"))
    rows = each.groupBy("c.kind", "c.votes", "c.features").agg(F.count(F.lit(1)).alias("n")) \
               .orderBy("kind", "votes", "features").collect()
    out = {}
    for kind, group in itertools.groupby(rows, key=lambda r: r["kind"]):
        group = list(group)
        table: dict[str, float] = defaultdict(float)
        for r in group:
            table[r["votes"]] += r["n"]
        post, _, _ = em(dict(table))
        out[kind] = train([(r["features"], post[r["votes"]], r["n"]) for r in group])
    return out


def accepted(models: dict[str, list[float]]) -> list[str]:
    """kind:features of all combinations that the classifiers accept; at most
    kinds x 2^FEATURES."""
    every = ["".join(f) for f in itertools.product("01", repeat=FEATURES)]
    return [f"{k}:{f}" for k, w in models.items() for f in every if score(w, f) >= 0.5]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: dict[str, list[float]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans, n_added.  ``models`` (classifiers fitted before)
    saves the pass that fits them.

    A null text counts as empty and has no spans (the digest is that of the
    empty string, spans is empty); null ids, repeated rows and long texts are
    like any other; an empty table gives no rows; other columns are not read.
    """
    c = with_candidates(docs, id_col, text_col)
    yes = accepted(fit(c) if models is None else models)
    d = c.select("doc_id", "base", F.filter("more", lambda x: F.concat(x["kind"], F.lit(":"), x["features"]).isin(yes)).alias("add"))
    order = lambda x: F.coalesce(*[F.when(x["kind"] == k, F.lit(i)) for k, i in ORDER.items()])

    def joined(a: Column) -> Column:
        key = F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("s"), order(x).alias("o"),
                                                             x["end"].alias("e"), x["kind"].alias("k"))))
        return F.array_join(F.transform(key, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                    joined(F.concat("base", "add")).alias("spans"), F.size("add").cast("long").alias("n_added"))
