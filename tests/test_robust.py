"""Robust baselines, quantile sketches, types of nested JSON and partition bounds."""
import collections
import datetime as dt
import json
import math
import random
import statistics

from pyspark.sql import functions as F

from relmon.operators import json_drift as J
from relmon.operators import quantiles as Q
from relmon.sinks import store as K

T0 = dt.datetime(2024, 1, 1)


def series(spark, data):
    rows = [(k, T0 + dt.timedelta(hours=i), None if v is None else float(v)) for k, vs in data.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "metric_name string, bucket timestamp_ntz, value double")


def test_median_and_mad_are_not_moved_by_spikes(spark):
    data = {"m": [10.0, 11, 12, 13, 14, 9000, None], "one": [5.0], "none": [None]}
    got = {r.metric_name: r for r in Q.robust_baselines(series(spark, data)).collect()}
    assert set(got) == {"m", "one"}
    assert (float(got["m"].median_value), float(got["m"].mad_value), got["m"].sample_size) == (12.5, 1.5, 6)
    assert math.isclose(float(got["m"].robust_std), 1.5 * 1.4826, abs_tol=1e-4)
    assert (float(got["one"].median_value), float(got["one"].mad_value)) == (5.0, 0.0)


def brute_clip(vals, k):
    lo, hi, rounds = -math.inf, math.inf, 0
    cur = [v for v in vals if v is not None]
    n = len(cur)
    while cur:
        m, sd = statistics.fmean(cur), statistics.stdev(cur) if len(cur) > 1 else 0.0
        lo, hi = max(lo, m - k * sd), min(hi, m + k * sd)
        left = [v for v in cur if lo <= v <= hi]
        if len(left) == len(cur):
            return m, sd, len(cur), n - len(cur), rounds
        cur, rounds = left, rounds + 1


def test_clipping_goes_on_to_the_fixed_point(spark):
    rnd = random.Random(1)
    data = {"many": [rnd.gauss(100, 3) for _ in range(300)] + [10.0 ** i for i in range(3, 9)], "flat": [4.0] * 20,
            "one": [3.0], "few": [1.0, 2, 3, 50, None]}
    for k in (2.0, 3.0):
        got = {r.metric_name: r for r in Q.clipped_baselines(series(spark, data), threshold=k).collect()}
        for name, vals in data.items():
            m, sd, n, gone, rounds = brute_clip(vals, k)
            r = got[name]
            assert (r.sample_size, r.rejected, r.rounds) == (n, gone, rounds), name
            assert math.isclose(float(r.mean_value), m, abs_tol=1e-3) and math.isclose(float(r.std_deviation), sd, abs_tol=1e-3)
    assert got["many"].rounds > 2
    assert Q.clipped_baselines(series(spark, data).limit(0)).collect() == []


def test_day_sketches_merge_within_their_error(spark, tmpdir_path):
    """Sketches of single days answer for the week, whatever the days hold."""
    rnd = random.Random(2)
    rows = [("hot", T0 + dt.timedelta(days=i % 7), rnd.lognormvariate(0, 2) + (i % 7) * 5) for i in range(20_000)]
    rows += [("small", T0 + dt.timedelta(days=i), float(i)) for i in range(5)] + [("small", T0, None)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    path = tmpdir_path + "/sketches"
    K.put_day_states(Q.day_sketches(d, "ts", "v", ["k"]), path)
    K.put_day_states(Q.day_sketches(d.filter("ts < timestamp_ntz'2024-01-03'"), "ts", "v", ["k"]), path)      # replayed days
    probs = [0.01, 0.25, 0.5, 0.9, 0.99]
    got = {(r.k, r.probability): (r.quantile, r.n) for r in Q.merged_quantiles(K.day_states(spark, path), probs, ["k"]).collect()}
    vals = sorted(v for k, _, v in rows if k == "hot")
    err = Q.rank_error()
    assert 0.005 < err < 0.02 and len(got) == 10
    for p in probs:
        q, n = got["hot", p]
        below, upto = sum(v < q for v in vals) / len(vals), sum(v <= q for v in vals) / len(vals)
        assert n == 20_000 and below <= p + err and upto >= p - err
    assert got["small", 0.5] == (2.0, 5)


NAMES = {bool: "BOOLEAN", int: "BIGINT", str: "STRING", type(None): "VOID", dict: "OBJECT", list: "ARRAY", float: "DECIMAL"}


def walk(v, path="$"):
    yield path, NAMES[type(v)]
    if isinstance(v, dict):
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}" if k.isidentifier() else f"{path}['{k}']")
    elif isinstance(v, list):
        for x in v:
            yield from walk(x, path + "[*]")


def brute_types(texts):
    occ, recs = collections.Counter(), collections.Counter()
    for t in texts:
        try:
            found = list(walk(json.loads(t)))
        except (TypeError, ValueError):
            continue
        occ.update(found)
        recs.update(set(found))
    return {k: (occ[k], recs[k]) for k in occ}


def records(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "raw string").select(F.try_parse_json("raw").alias("record"))


def nested(rnd, depth=0):
    kind = rnd.randrange(8) if depth < 5 else rnd.randrange(5)
    if kind < 5:
        return [None, True, rnd.randrange(100), "s", 2.5][kind]
    if kind < 7:
        return {rnd.choice(["a", "b", "c d", "e.f"]): nested(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [nested(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def test_path_types_against_a_walk_of_every_record(spark):
    rnd = random.Random(3)
    texts = [json.dumps(nested(rnd)) for _ in range(300)] + [None, "{broken", "", '{"a":{"b":1},"a.b":[[]]}', "[]"]
    got = {(r.path, r.type): (r.occurrences, r.records) for r in J.path_types(records(spark, texts)).collect()}
    assert got == brute_types(texts)
    half = J.merge_types(J.path_types(records(spark, texts[:99])), J.path_types(records(spark, texts[99:])))
    assert {(r.path, r.type): (r.occurrences, r.records) for r in half.collect()} == got
    assert J.path_types(records(spark, [None, "{"])).collect() == []
    top = {r.path for r in J.path_types(records(spark, texts), max_depth=1).collect()}
    assert all(p.count("[*]") + p.count(".") <= 2 for p in top) and "$.a" in top


def test_drift_names_what_changed(spark):
    old = J.path_types(records(spark, ['{"a":1,"gone":true,"n":1}', '{"a":2,"gone":null,"n":1}']))
    new = J.path_types(records(spark, ['{"a":"x","b":{"c":1},"n":1}', '{"a":2,"n":1}']))
    got = {(r.path, r.type): (r.old_share, r.new_share, r.change) for r in J.type_drift(old, new).collect()}
    assert got == {("$.a", "BIGINT"): (1.0, 0.5, "SHARE"), ("$.a", "STRING"): (0.0, 0.5, "NEW_TYPE"), ("$.gone", "BOOLEAN"): (0.5, 0.0, "LOST_FIELD"),
                   ("$.gone", "VOID"): (0.5, 0.0, "LOST_FIELD"), ("$.b", "OBJECT"): (0.0, 0.5, "NEW_FIELD"), ("$.b.c", "BIGINT"): (0.0, 0.5, "NEW_FIELD")}
    assert J.type_drift(old, new, 0.6).collect() == []


def test_part_bounds_cut_on_the_nearer_side_of_a_value(spark):
    from relmon.sources.ranges import part_counts, quantile_bounds, range_predicates

    def parts(counts, n):
        d = spark.createDataFrame([(k,) for k, c in counts.items() for _ in range(c)], "k long")
        preds = range_predicates(d, "k", n)
        return quantile_bounds(d, "k", n), [r["rows"] for r in part_counts(d, preds).orderBy("part").collect()]
    assert parts({1: 1, 2: 9, 3: 10}, 2) == ([3], [10, 10])                     # not 1 and 19
    assert parts({1: 9, 2: 2, 3: 9}, 2) == ([2], [9, 11])                       # a tie stays in front
    assert parts({1: 4, 2: 11, 3: 15}, 3) == ([2, 3], [4, 11, 15])              # the cut behind 2 is there
    assert parts({1: 40}, 4)[1] == [0, 40]
    assert parts({None: 3, 1: 1, 2: 9, 3: 10}, 2) == ([3], [13, 10])            # rows without a value go first
    assert parts({None: 3}, 2) == ([], [3])
