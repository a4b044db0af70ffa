"""Scalar and array functions over depth profiles. Profiles are ARRAY<DOUBLE>; NaN means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
IGNORE, OVERLAP, SEABED, BORDER, OTHER = -100, -70, -50, -30, -10
EPS = 1e-10
FLOOR_DB = -75.0


def each(profile: str | Column, f) -> Column:
    return F.transform(profile, f)


def db(x: Column) -> Column:
    """10 log10(x + 1e-10) with numpy's results at and below zero."""
    y = x.cast("double") + F.lit(EPS)
    # the logarithm is null at and below zero; elsewhere y is evaluated once
    return F.coalesce(10 * F.log10(y), F.when(y == 0, F.lit(float("-inf"))).otherwise(F.lit(NAN)))


def clip(x: Column, low: float = FLOOR_DB, high: float = 0.0) -> Column:
    """low <= x <= high; NaN stays NaN, as it is above all numbers for greatest()."""
    return -F.greatest(-F.greatest(x, F.lit(low)), F.lit(-high))


def db_clipped(x: Column) -> Column:
    return clip(db(x))


def db_scaled(x: Column) -> Column:
    """Clipped decibels mapped to 0..1."""
    return 1 + db_clipped(x) / 75.0


def is_finite(x: Column) -> Column:
    return F.abs(x) < F.lit(float("inf"))  # NaN is above infinity


def without_non_finite(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(0.0)


def labels_without_missing(labels: Column | str, first: Column | str) -> Column:
    """Labels, IGNORE where the first frequency is not finite."""
    return F.zip_with(labels, first, lambda y, v: F.when(is_finite(v), y).otherwise(IGNORE))


def data_with_border(sv: Column | str, labels: Column | str, value: float = 0.0) -> Column:
    """Data, `value` where the label is IGNORE."""
    return F.zip_with(sv, labels, lambda v, y: F.when(y == IGNORE, value).otherwise(v))


def species_class(y: Column) -> Column:
    """0 background, 1 sandeel (27), 2 other (1), IGNORE for anything else."""
    return F.when(y == 0, 0).when(y == 27, 1).when(y == 1, 2).otherwise(IGNORE)


def species_class_other(y: Column) -> Column:
    """species_class with OTHER for further positive species."""
    return F.when(y == 0, 0).when(y == 27, 1).when(y == 1, 2).when(y > 0, OTHER).otherwise(IGNORE)


def evaluation_label(y: Column) -> Column:
    """Internal codes to IGNORE, the seabed code to background."""
    return F.when(y.isin(OVERLAP, BORDER, IGNORE, OTHER), IGNORE).when(y == SEABED, 0).otherwise(y)


def score_above_seabed(score: Column, y: Column) -> Column:
    """The score, 0 where the label is the seabed code (before evaluation_label merges the codes)."""
    return F.when(y == SEABED, 0.0).otherwise(score)


def softmax(*scores: Column) -> list[Column]:
    top = F.greatest(*scores)
    weights = [F.exp(s - top) for s in scores]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def half_precision(p: Column) -> Column:
    """Rounds to the nearest half-precision number (half to even), for 0 <= p < 65504."""
    exponent = F.greatest(F.floor(F.log2(F.when(p > 0, p))), F.lit(-14))
    # log2 may land just beside an exact power of two
    exponent = F.when(p < F.pow(F.lit(2.0), exponent), exponent - 1).when(p >= F.pow(F.lit(2.0), exponent + 1), exponent + 1).otherwise(exponent)
    ulp = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14)) - 10)
    return F.when(p == 0, 0.0).otherwise(F.rint(p / ulp) * ulp)


def khz_to_hz(f: Column) -> Column:
    return f * 1000


def datenum(t: Column) -> Column:
    """Days since year 0 as a real number, of a TIMESTAMP_NTZ or TIMESTAMP column (session zone UTC)."""
    return F.unix_micros(t.cast("timestamp")) / 86400e6 + 719529


def from_datenum(d: Column) -> Column:
    return F.timestamp_micros(F.rint((d - 719529) * 86400e6).cast("bigint"))


def portion_of_day(d: Column) -> Column:
    return d - F.floor(d)


def portion_of_year(t: Column) -> Column:
    return F.month(t) / 12.0 + F.dayofmonth(t) / 366.0 + F.hour(t) / 366.0 / 24.0


def ping_step_days(rate_per_second: Column) -> Column:
    return 1 / rate_per_second / 86400.0


def year_of_name(name: Column) -> Column:
    """Year from characters 9 to 12 (0-based) of an echogram name."""
    return F.substring(name, 10, 4).cast("int")


def category_of_mask_id(mask_id: Column) -> Column:
    return F.element_at(F.split(mask_id, "-"), -1).cast("int")


#: Species code and display name.
SPECIES_NAMES = {27: "Sandeel", 1: "Other", 6009: "Possible s.e.", 5027: "0-group"}


def keyed_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key (>= 0) and seed only; BIGINT arithmetic that stays below 2**63."""
    m = F.lit(1 << 31)
    half = lambda x: F.shiftright(x * x, 16)
    x1 = ((key.cast("bigint") % m) * 1103515245 + seed * 12345 + 12345) % m
    x2 = (half(x1) + x1) % m
    x3 = (x2 * 1103515245 + 12345 + seed * 7919) % m
    return ((half(x3) + x3) % m) / F.lit(2147483648.0)


def keyed_uniform_sql(key: str, seed: int) -> str:
    """keyed_uniform for DuckDB."""
    x1 = f"((({key})::BIGINT % 2147483648) * 1103515245 + {seed * 12345 + 12345}) % 2147483648"
    x2 = f"((({x1}) * ({x1})) // 65536 + ({x1})) % 2147483648"
    x3 = f"(({x2}) * 1103515245 + {12345 + seed * 7919}) % 2147483648"
    return f"((((({x3}) * ({x3})) // 65536 + ({x3})) % 2147483648) / 2147483648.0::DOUBLE)"
