import pytest
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators import profile as P


def _z_rows(spark, values, mean=1000.0, sd=100.0):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    z = S.signed_z("x", F.lit(mean), F.lit(sd))
    return df.select("x", z.alias("z"), S.is_anomaly(z).alias("a"), S.is_anomaly(z, inclusive=True).alias("ai"),
                     S.severity_band(z).alias("band")).orderBy("x").collect()


def test_z_scores_and_threshold(spark):
    rows = {r.x: r for r in _z_rows(spark, [1050, 1350, 400, 1450, 1300])}
    assert rows[1050].z == pytest.approx(0.5) and not rows[1050].a
    assert rows[1350].z == pytest.approx(3.5) and rows[1350].a
    assert rows[400].z == pytest.approx(-6.0) and rows[400].a
    assert rows[1450].z == pytest.approx(4.5) and rows[1450].a
    # exactly 3.0: strict rule says no anomaly, the inclusive form says yes; band is critical
    assert rows[1300].z == pytest.approx(3.0) and not rows[1300].a and rows[1300].ai
    assert rows[1300].band == "critical"


def test_bands(spark):
    df = spark.createDataFrame([(z,) for z in (1.5, 2.5, 3.5, -2.8, -4.0)], "z double")
    got = [r.b for r in df.select(S.severity_band("z").alias("b")).collect()]
    assert got == ["normal", "moderate", "critical", "moderate", "critical"]


def test_zero_sd_gives_zero(spark):
    r = spark.range(1).select(S.signed_z(F.lit(5.0), F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert r.z == 0.0


def test_sample_sd_and_single_bucket(spark):
    # fixed values: the sample whose mean and deviations must come out the same
    vals = [950, 1050, 1100, 900, 1200, 980, 1020, 1150, 890, 1160]
    s = spark.createDataFrame([("m", float(v)) for v in vals], "metric_name string, value double")
    b = P.baselines(s).first()
    assert float(b.mean_value) == pytest.approx(1040.0)
    assert float(b.std_deviation) == pytest.approx(110.5542, abs=1e-4)
    assert b.sample_size == 10
    one = P.baselines(spark.createDataFrame([("m", 7.0)], "metric_name string, value double")).first()
    assert float(one.std_deviation) == 0.0 and one.sample_size == 1


def test_half_even_rounding(spark):
    r = spark.range(1).select(S.round_half_even(F.lit(81.25), 1).alias("a"),
                              S.round_half_even(F.lit(66.666666), 1).alias("b")).first()
    assert r.a == 81.2 and r.b == 66.7
