"""Column expressions for scoring.  All built-in, so they stay inside
whole-stage codegen; none of them needs a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relmon.specs import DEFAULT_STALENESS_MINUTES, DEFAULT_Z_THRESHOLD

# Storage types of the baselines / alerts tables.
STAT_TYPE = "decimal(15,4)"
Z_TYPE = "decimal(10,4)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _k(k) -> Column:
    return k if isinstance(k, Column) else F.lit(float(k))


def as_stat(x) -> Column:
    """The DECIMAL(15,4) storage type of means, deviations and values; a value
    too large for it is stored as NULL (it never ends the job)."""
    return _c(x).try_cast(STAT_TYPE)


def as_z(x) -> Column:
    """The DECIMAL(10,4) storage type of z-scores, NULL beyond it; flags are
    computed from the double before this."""
    return _c(x).try_cast(Z_TYPE)


def signed_z(value, mean, std) -> Column:
    """(x - mean) / std in double; 0.0 when std is 0 (never an anomaly)."""
    v, m, s = _c(value).cast("double"), _c(mean).cast("double"), _c(std).cast("double")
    return F.when(s == 0, F.lit(0.0)).otherwise((v - m) / s)


def abs_z(value, mean, std) -> Column:
    return F.abs(signed_z(value, mean, std))


def is_anomaly(z, threshold=DEFAULT_Z_THRESHOLD, inclusive: bool = False) -> Column:
    """Strict ``abs z > k`` by default; ``inclusive`` gives ``>=``."""
    a = F.abs(_c(z))
    return (a >= threshold) if inclusive else (a > threshold)


def severity_band(z) -> Column:
    """Below 2 normal, below 3 moderate, otherwise critical (on abs z)."""
    a = F.abs(_c(z))
    return (F.when(a.isNull(), F.lit(None))
            .when(a < 2.0, F.lit("normal"))
            .when(a < 3.0, F.lit("moderate"))
            .otherwise(F.lit("critical")))


def threshold_value(mean, std, k=DEFAULT_Z_THRESHOLD) -> Column:
    """Upper alert bound mean + k*std (reported even for drops)."""
    return _c(mean).cast("double") + _k(k) * _c(std).cast("double")


def expected_low(mean, std, k=DEFAULT_Z_THRESHOLD) -> Column:
    return _c(mean).cast("double") - _k(k) * _c(std).cast("double")


def drop_pct(value, mean) -> Column:
    """Percent drop against the baseline mean: (1 - x/mean) * 100; NULL for mean 0."""
    m = _c(mean).cast("double")
    return F.when(m == 0, F.lit(None)).otherwise((F.lit(1.0) - _c(value).cast("double") / m) * 100.0)


def minutes_between(earlier, later) -> Column:
    """Elapsed minutes (fractional), microsecond exact, works on TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)).cast("double") / 6.0e7


def staleness_factor(minutes, threshold=DEFAULT_STALENESS_MINUTES) -> Column:
    return _c(minutes) / F.lit(float(threshold))


def impact_level(factor) -> Column:
    """Staleness impact by how far past the threshold (own rule; the source
    only shows HIGH for a factor of 1.5): >=3 CRITICAL, >=1.5 HIGH, >1 MEDIUM, else NONE."""
    f = _c(factor)
    return (F.when(f.isNull(), F.lit(None)).when(f >= 3.0, F.lit("CRITICAL"))
            .when(f >= 1.5, F.lit("HIGH")).when(f > 1.0, F.lit("MEDIUM")).otherwise(F.lit("NONE")))


def round_half_even(x, scale: int = 1) -> Column:
    """Scores are rounded half-even to one decimal (bround, not round)."""
    return F.bround(_c(x), scale)


def hour_bucket(ts) -> Column:
    """Start of the hour as TIMESTAMP_NTZ without any time-zone round trip."""
    t = _c(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


def day_bucket(ts) -> Column:
    return F.to_date(_c(ts))


def bucket(ts, grain: str) -> Column:
    if grain == "hour":
        return hour_bucket(ts)
    if grain == "day":
        return day_bucket(ts)
    raise ValueError(grain)


def fixed(x, digits: int) -> Column:
    """Decimal text with ``digits`` places (HALF_UP on the stored decimal), for
    alert descriptions such as ``Z-Score: 3.60``."""
    return F.round(_c(x).try_cast("decimal(38,10)"), digits).try_cast(f"decimal(28,{digits})").cast("string")
