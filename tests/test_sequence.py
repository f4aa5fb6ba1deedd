"""As-of join, running smoothing, chained back-off and mergeable states against
plain Python versions; hot keys, ties, nulls and any partitioning."""
import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from relmon.operators import moments as M
from relmon.operators.backoff import backoff
from relmon.operators.sequence import asof_join, smoothed_series
from relmon.sinks import store as K

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def sides(seed=1, hot=0.6):
    rnd = random.Random(seed)
    left = [(i, "hot" if rnd.random() < hot else rnd.choice(["a", "b", None]), None if rnd.random() < .03 else at(rnd.randrange(400)), rnd.random())
            for i in range(600)]
    right = [(rnd.choice(["hot", "hot", "a", "c", None]), None if rnd.random() < .05 else at(rnd.randrange(400)), rnd.randrange(1000))
             for _ in range(120)]
    return left, right


def brute_asof(left, right, direction="backward", exact=True, tolerance=None):
    out = []
    for i, k, t, _ in left:
        fits = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None
                and ((rt < t if direction == "backward" else rt > t) or (exact and rt == t))]
        pick = None
        if fits:
            best = (max if direction == "backward" else min)(rt for rt, _ in fits)
            if tolerance is None or abs((best - t).total_seconds()) <= tolerance * 60:
                pick = (best, max(v for rt, v in fits if rt == best))
        out.append((i, *(pick or (None, None))))
    return sorted(out)


@pytest.mark.parametrize("direction,exact,tolerance", [("backward", True, None), ("backward", False, None), ("forward", True, None),
                                                       ("forward", False, 3.0), ("backward", True, 2.0)])
def test_asof_join_against_brute_force(spark, direction, exact, tolerance):
    left, right = sides()
    ld = spark.createDataFrame(left, "id long, k string, ts timestamp_ntz, x double")
    rd = spark.createDataFrame(right, "k string, valid timestamp_ntz, v long")
    want = brute_asof(left, right, direction, exact, tolerance)
    for parts in (1, 7):
        j = asof_join(ld, rd, ["k"], "ts", "valid", ["v"], direction, exact, tolerance, partitions=parts)
        assert j.columns == ["id", "k", "ts", "x", "valid", "v"]
        assert sorted((r.id, r.valid, r.v) for r in j.collect()) == want


def test_asof_join_spreads_a_hot_key_and_one_time(spark):
    """All left rows have one key and one time; they lie in many ranges and all find the one version."""
    ld = spark.range(4000).select("id", F.lit("k").alias("k"), F.lit(at(10)).cast("timestamp_ntz").alias("ts"))
    rd = spark.createDataFrame([("k", at(3), 1), ("k", at(9), 2), ("k", at(11), 3)], "k string, valid timestamp_ntz, v long")
    j = asof_join(ld, rd, ["k"], "ts", "valid", ["v"], partitions=8)
    assert {(r.valid, r.v) for r in j.select("valid", "v").distinct().collect()} == {(at(9), 2)} and j.count() == 4000
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    import re
    raw = [w for w in re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", plan) if "_tie" in w]
    assert raw and all("_part" in w for w in raw)           # no window over the raw rows of one key


def test_asof_join_empty_sides_and_clashes(spark):
    left, right = sides()
    ld = spark.createDataFrame(left, "id long, k string, ts timestamp_ntz, x double")
    rd = spark.createDataFrame(right, "k string, valid timestamp_ntz, v long")
    assert asof_join(ld.limit(0), rd, ["k"], "ts", "valid", ["v"]).collect() == []
    assert {r.v for r in asof_join(ld, rd.limit(0), ["k"], "ts", "valid", ["v"]).collect()} == {None}
    with pytest.raises(ValueError):
        asof_join(ld, rd.withColumnRenamed("v", "x"), ["k"], "ts", "valid", ["x"])


def brute_smooth(rows, alpha):
    out, state = {}, {}
    for k, t, x in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[0], r[1])):
        state[k] = x if k not in state else alpha * x + (1 - alpha) * state[k]
        out[k, t] = state[k]
    return out


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.99, 1.0])
def test_smoothed_series_is_the_running_rule_for_any_partitioning(spark, alpha):
    rnd = random.Random(2)
    rows = [("hot", at(i), rnd.uniform(-50, 100)) for i in range(3000)] + [(k, at(i), rnd.uniform(0, 9)) for k in "ab" for i in range(5)]
    rows += [("a", None, 1.0), ("b", at(77), None)]
    rnd.shuffle(rows)
    want = brute_smooth(rows, alpha)
    d = spark.createDataFrame(rows, "k string, bucket timestamp_ntz, value double")
    for parts in (1, 6):
        got = {(r.k, r.bucket): r.smoothed_value for r in smoothed_series(d, ["k"], alpha=alpha, partitions=parts).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[x], want[x], rel_tol=1e-9, abs_tol=1e-9) for x in want)
    assert smoothed_series(d.limit(0), ["k"], alpha=alpha).collect() == []


def brute_backoff(rows, base, factor, top, reset):
    kept, last = [], {}
    for k, t, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        if k in last:
            lt, lv = last[k]
            gap = (t - lt).total_seconds() / 60
            if gap < base * factor ** lv or gap == 0:
                continue
            lv = 0 if gap >= reset else min(lv + 1, top)
        else:
            lv = 0
        last[k] = (t, lv)
        kept.append((i, lv))
    return sorted(kept + [(r[2], 0) for r in rows if r[1] is None])


@pytest.mark.parametrize("base,factor,top,reset", [(5, 2.0, 3, 100), (5, 2.0, 0, 50), (1, 3.0, 2, 20), (7, 1.0, 1, 1000)])
def test_backoff_is_the_sequential_rule(spark, base, factor, top, reset):
    rnd = random.Random(3)
    rows, t = [], 0.0
    for i in range(500):
        t += rnd.choice([0, 0.5, 1, 2, 4, 30 if i % 90 == 0 else 1, 200 if i % 170 == 0 else 1])
        rows.append((rnd.choice(["noisy", "noisy", "noisy", "x", None]), at(t), i))
    rows += [("noisy", None, 900), ("noisy", rows[3][1], 901)]
    d = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long").repartition(5)
    out = backoff(d, base, factor, top, reset, key=["k"], ts_col="ts", order_cols=["id"], partitions=4)
    assert sorted((r.id, r.backoff_level) for r in out.collect()) == brute_backoff(rows, base, factor, top, reset)
    assert all(r.wait_minutes == base * factor ** r.backoff_level for r in out.collect())


def test_backoff_of_equal_times_and_no_alerts(spark):
    d = spark.createDataFrame([("k", at(1), i) for i in range(50)], "k string, ts timestamp_ntz, id long")
    assert [(r.id, r.backoff_level) for r in backoff(d, 5, key=["k"], ts_col="ts", order_cols=["id"]).collect()] == [(0, 0)]
    assert backoff(d.limit(0), 5, key=["k"], ts_col="ts").collect() == []
    with pytest.raises(ValueError):
        backoff(d, 0, key=["k"], ts_col="ts")


def test_states_merge_without_cancellation(spark):
    """Large values with a small spread: sums of squares would lose it."""
    rnd = random.Random(4)
    vals = [1e9 + rnd.random() for _ in range(900)]
    rows = [("m", T0 + dt.timedelta(days=i % 9, minutes=i // 9), v) for i, v in enumerate(vals)] + [("one", T0, 5.0)]
    s = spark.createDataFrame(rows, "metric_name string, bucket timestamp_ntz, value double")
    states = M.day_states(s)
    assert states.count() == 10
    got = {r.metric_name: r for r in M.window_baselines(states.repartition(7), "2024-01-10", 9).collect()}
    assert got["m"].sample_size == 900 and got["m"].days == 9
    assert math.isclose(float(got["m"].std_deviation), statistics.stdev(vals), abs_tol=1e-4)
    assert (float(got["one"].mean_value), float(got["one"].std_deviation), got["one"].sample_size) == (5.0, 0.0, 1)
    part = {r.metric_name: r for r in M.window_baselines(states, "2024-01-10", 3).collect()}
    inside = [v for i, v in enumerate(vals) if i % 9 >= 6]
    assert set(part) == {"m"} and part["m"].sample_size == len(inside)
    assert math.isclose(float(part["m"].std_deviation), statistics.stdev(inside), abs_tol=1e-4)


def test_stored_day_states(spark, tmpdir_path):
    path = tmpdir_path + "/states"
    assert K.day_states(spark, path) is None
    rows = [("m", T0 + dt.timedelta(days=d, hours=h), float(10 * d + h)) for d in range(6) for h in range(3)]
    s = spark.createDataFrame(rows, "metric_name string, bucket timestamp_ntz, value double")
    K.put_day_states(M.day_states(s.filter("bucket < timestamp_ntz'2024-01-06'")), path)
    last = s.filter("bucket >= timestamp_ntz'2024-01-06'")
    for _ in range(2):
        K.put_day_states(M.day_states(last), path)
    st = K.day_states(spark, path)
    assert st.count() == 6
    more = last.unionByName(spark.createDataFrame([("m", T0 + dt.timedelta(days=5, hours=9), 99.0)], s.schema))
    K.put_day_states(M.day_states(more), path)          # late rows: the day replaces itself
    b = M.window_baselines(K.day_states(spark, path), "2024-01-07", 2).first()
    assert b.sample_size == 7 and b.days == 2
    assert K.drop_expired_states(spark, path, "2024-01-07", 2) == [f"state_day=2024-01-0{i}" for i in (1, 2, 3, 4)] or \
        sorted(p for p in [r.state_day for r in K.day_states(spark, path).select("state_day").distinct().collect()])[0] == dt.date(2024, 1, 5)
    # the window's filter reaches the file listing
    plan = M.window_baselines(K.day_states(spark, path), "2024-01-07", 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(state_day" in plan
