"""Regridding, resampling and sanity checks of survey grids."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def regrid_range(profile: Column | str, first: float, step: float, n_old: int, new_step: float, n_new: int) -> Column:
    """Conservative regrid along range: each new bin is the overlap-weighted mean of old bins, NaN if all are missing.

    Old bins are centred at first + i * step; new ones start at the same upper edge. A new bin looks
    at the few old ones that it can overlap, so the work grows with the bins, not with their product;
    whole Arrow batches of profiles are regridded at once.
    """
    top = first - step / 2
    reach = math.ceil(new_step / step) + 1
    j = np.arange(n_new)
    start = np.floor(j * (new_step / step)).astype(int)
    lo, hi = top + j * new_step, top + (j + 1) * new_step

    @F.arrow_udf("array<double>")
    def run(profiles: pa.Array) -> pa.Array:
        old = _cells(profiles)
        w, v = np.zeros((len(old), n_new)), np.zeros((len(old), n_new))
        for k in range(reach):
            i = start + k
            there = np.flatnonzero(i < old.shape[1])
            i = i[there]
            share = np.maximum(np.minimum(hi[there], top + (i + 1) * step) - np.maximum(lo[there], top + i * step), 0.0)
            cells = old[:, i]
            known = ~np.isnan(cells)
            w[:, there] += np.where(known, share, 0.0)
            v[:, there] += np.where(known, share * cells, 0.0)
        out = np.divide(v, w, out=np.full(w.shape, np.nan), where=w > 1e-12)
        # a missing profile has missing bins
        flat = pa.array(out.ravel(), mask=np.repeat(np.asarray(profiles.is_null()), n_new))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(old) + 1, dtype=np.int32) * n_new), flat)

    return run(profile)


def _cells(profiles: pa.Array) -> np.ndarray:
    """Profiles as rows of the longest one's length, NaN for missing cells."""
    size = pc.fill_null(pc.list_value_length(profiles), 0).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(profiles.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    h = int(size.max()) if len(size) else 0
    if (size == h).all():
        return flat.reshape(len(size), h)
    out = np.full((len(size), h), np.nan)
    out[np.arange(h) < size[:, None]] = flat
    return out


def regrid_pings(sv: DataFrame, bounds: DataFrame, step: float) -> DataFrame:
    """Conservative regrid along pings: raw_file, freq_hz, bin, r, v.

    bounds(raw_file, ping_idx, t0, t1) are ping edges in the unit of step from the file's start.
    Each ping is exploded to the bins it overlaps; weights are overlap lengths.
    """
    bins = F.sequence(F.floor(F.col("t0") / step).cast("int"), F.floor(F.col("t1") / step).cast("int"))
    parts = bounds.filter("t1 > t0").select("raw_file", "ping_idx", "t0", "t1", F.explode(bins).alias("bin"))
    parts = parts.withColumn("w", F.least("t1", (F.col("bin") + 1) * step) - F.greatest("t0", F.col("bin") * step)).filter("w > 0")
    cells = sv.join(parts, ["raw_file", "ping_idx"]).select("raw_file", "freq_hz", "bin", "w", F.posexplode("sv").alias("r", "v"))
    ok = ~F.isnan("v")
    out = cells.groupBy("raw_file", "freq_hz", "bin", "r").agg(F.sum(F.when(ok, F.col("w") * F.col("v"))).alias("s"), F.sum(F.when(ok, F.col("w"))).alias("t"))
    return out.select("raw_file", "freq_hz", "bin", "r", F.coalesce(F.try_divide("s", "t"), F.lit(float("nan"))).alias("v"))


def ping_bounds(ping: DataFrame) -> DataFrame:
    """raw_file, ping_idx, t0, t1: midpoints between ping times in seconds from the first ping, edges extrapolated."""
    order = Window.partitionBy("raw_file").orderBy("ping_idx")
    whole = Window.partitionBy("raw_file")
    seconds = F.unix_micros(F.col("ping_time").cast("timestamp")) / 1e6
    rows = ping.select("raw_file", "ping_idx", seconds.alias("t")).withColumn("t", F.col("t") - F.min("t").over(whole))
    rows = rows.withColumn("p", F.lag("t").over(order)).withColumn("n", F.lead("t").over(order))
    half_up, half_down = (F.col("n") - F.col("t")) / 2, (F.col("t") - F.col("p")) / 2
    return rows.select("raw_file", "ping_idx", (F.col("t") - F.coalesce(half_down, half_up, F.lit(0.5))).alias("t0"), (F.col("t") + F.coalesce(half_up, half_down, F.lit(0.5))).alias("t1"))


def energy(sv: DataFrame, by: list[str]) -> DataFrame:
    """by, total: sum of all cells without the missing ones."""
    cells = sv.select(*by, F.explode("sv").alias("v"))
    return cells.groupBy(*by).agg(F.sum(F.when(F.isnan("v"), 0.0).otherwise(F.col("v"))).alias("total"))


def energy_kept(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """by, kept: whether totals differ by at most a 5000th of the old one."""
    joined = energy(old, by).withColumnRenamed("total", "a").join(energy(new, by).withColumnRenamed("total", "b"), by)
    return joined.select(*by, (F.abs(F.col("b") - F.col("a")) <= F.col("a") / 5000).alias("kept"))


def ping_rate_ok(ping: DataFrame, expected: float, tolerance: float = 0.05) -> DataFrame:
    """raw_file, rate_ok: all rates between neighbours lie within the tolerance."""
    order = Window.partitionBy("raw_file").orderBy("ping_idx")
    micros = F.unix_micros(F.col("ping_time").cast("timestamp"))
    rows = ping.withColumn("__d", (micros - F.lag(micros).over(order)) / 1e6)
    return rows.groupBy("raw_file").agg(F.coalesce(F.bool_and(F.abs(F.try_divide(F.lit(1.0), F.col("__d")) - expected) <= tolerance), F.lit(True)).alias("rate_ok"))


def unsteady_depth(ping: DataFrame) -> DataFrame:
    """Files whose transducer depth is not constant."""
    return ping.groupBy("raw_file").agg(F.min("transducer_depth_m").alias("lo"), F.max("transducer_depth_m").alias("hi")).filter("lo <> hi").select("raw_file")


def range_limit(bottom: DataFrame, by: list[str], quantile: float = 0.95, margin: float = 15.0) -> DataFrame:
    """by, max_range: an interpolated percentile of the bottom depth plus a margin."""
    return bottom.groupBy(*by).agg((F.percentile("depth", F.lit(quantile)) + margin).alias("max_range"))


def bin_means(profile: Column | str, first: float, step: float, e0: float, dz: float, n_new: int) -> Column:
    """Means of the bins whose centre first + i * step falls into e0 + j * dz .. e0 + (j + 1) * dz; null when empty."""
    reach = math.ceil(dz / step) + 2

    def one(j: Column) -> Column:
        # a little earlier than the first centre of the bin; floor() below decides
        start = F.greatest(F.floor((e0 + j * dz - first) / step).cast("int"), F.lit(0))
        entries = F.zip_with(F.slice(profile, start + 1, F.lit(reach)), F.sequence(start, start + (reach - 1)), lambda v, i: F.struct(F.floor((first + i * step - e0) / dz).cast("int").alias("j"), v.alias("v")))
        own = F.filter(entries, lambda p: (p["j"] == j) & p["v"].isNotNull() & ~F.isnan(p["v"]))
        none = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
        return F.aggregate(own, none, lambda a, p: F.struct((a["s"] + p["v"]).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))

    return F.transform(F.sequence(F.lit(0), F.lit(n_new - 1)), one)


def interpolated_range(profile: Column | str, first: float, step: float, new_first: float, new_step: float, n_new: int) -> Column:
    """Linear interpolation at new_first + j * new_step; null outside the old centres."""

    def one(j: Column) -> Column:
        x = (new_first + j * new_step - first) / step
        i = F.floor(x).cast("int")
        a, b = F.when(i >= 0, F.get(profile, i)), F.when(i >= 0, F.get(profile, i + 1))
        return F.when(x == i, a).otherwise(a + (x - i) * (b - a))

    return F.transform(F.sequence(F.lit(0), F.lit(n_new - 1)), one)


def range_choice(files: DataFrame, dz: float, tolerance: float = 0.05) -> DataFrame:
    """files(raw_file, range_m) -> raw_file, dr, choice: average finer grids, interpolate coarser ones, else keep."""
    diffs = F.transform(F.sequence(F.lit(1), F.size("range_m") - 1), lambda i: F.get("range_m", i) - F.get("range_m", i - 1))
    rows = files.select("raw_file", F.explode(diffs).alias("d")).groupBy("raw_file").agg(F.median("d").alias("dr"))
    return rows.withColumn("choice", F.when(F.col("dr") < dz - tolerance, "average").when(F.col("dr") > dz + tolerance, "interpolate").otherwise("keep"))


def tile_counts(labels: DataFrame, height: int, width: int, step_y: int, step_x: int) -> DataFrame:
    """Overlapping tiles with their number of labelled cells: raw_file, ty, tx, n; tile (ty, tx) starts at (ty * step_y, tx * step_x)."""
    cells = labels.select("raw_file", "ping_idx", F.posexplode("labels").alias("r", "y")).filter("y <> 0")

    def starts(c: str, size: int, step: int) -> Column:
        return F.sequence(F.greatest(F.ceil((F.col(c) - size + 1) / F.lit(float(step))), F.lit(0)).cast("int"), F.floor(F.col(c) / F.lit(float(step))).cast("int"))

    both = cells.withColumn("ty", F.explode(starts("r", height, step_y))).withColumn("tx", F.explode(starts("ping_idx", width, step_x)))
    return both.groupBy("raw_file", "ty", "tx").agg(F.count("*").alias("n"))
