"""Slices, crops, tiles, and sampling of profiles.

Rows are pings (raw_file, ping_idx) with a profile array; the range index is the place in
the array. Bounds are half open unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.acoustic import IGNORE, NAN


def box_slice(sv: DataFrame, freqs: Sequence[int] | None = None, ping: tuple[int, int] | None = None, rng: tuple[int, int] | None = None) -> DataFrame:
    """Rows of some frequencies and pings, with range bins rng[0] .. rng[1] - 1 of each profile."""
    if freqs is not None:
        sv = sv.filter(F.col("freq_hz").isin(list(freqs)))
    if ping is not None:
        sv = sv.filter((F.col("ping_idx") >= ping[0]) & (F.col("ping_idx") < ping[1]))
    return sv if rng is None else sv.withColumn("sv", F.slice("sv", rng[0] + 1, rng[1] - rng[0]))


def raw_file_slice(raw_files: Sequence[str], sv: DataFrame, labels: DataFrame, seabed: DataFrame) -> DataFrame:
    """Profiles of some raw files with labels and seabed_idx of their pings; the files are chosen where each table is read."""
    own = lambda df: df.filter(F.col("raw_file").isin(list(raw_files)))
    keys = ["raw_file", "ping_idx"]
    return own(sv).join(own(labels).select(*keys, "labels"), keys, "left").join(own(seabed).select(*keys, "seabed_idx"), keys, "left")


def complete_bins(sv: DataFrame, by: Sequence[str] = ("raw_file",), lo: int = 0) -> DataFrame:
    """by, r: range bins without a NaN in any row of the group; counts per bin are aggregated before the shuffle."""
    cells = sv.select(*by, F.posexplode("sv").alias("r", "v"))
    return cells.groupBy(*by, "r").agg(F.max(F.isnan("v").cast("int")).alias("bad")).filter("bad = 0").select(*by, (F.col("r") + lo).alias("r"))


def merge_categories(annotation: DataFrame, order: Sequence[int]) -> DataFrame:
    """Masks (raw_file, ping_idx, category, mask), one for each ping and category -> one label array per ping; the last set category wins, NaN is unset."""
    order = [c for c in order if c != -1]
    kept = annotation.filter(F.col("category").isin(order))
    # masks of a ping stand side by side after a join by ping: one maximum per category goes along them, no list of them is held
    stacked = kept.groupBy("raw_file", "ping_idx").agg(*[F.max(F.when(F.col("category") == c, F.col("mask"))).alias(f"__m{i}") for i, c in enumerate(order)])
    masks = [F.col(f"__m{i}") for i in range(len(order))]
    length = F.greatest(*[F.size(F.coalesce(m, F.array())) for m in masks]) if len(masks) > 1 else F.size(masks[0])
    hit = lambda m, r: F.coalesce(~F.isnan(F.get(m, r).cast("double")) & (F.get(m, r) > 0), F.lit(False))
    label = lambda _, r: F.coalesce(*[F.when(hit(m, r), F.lit(c)) for m, c in reversed(list(zip(masks, order, strict=True)))], F.lit(0))
    unset = F.array_repeat(F.lit(0), length)
    some = reduce(or_, [F.coalesce(F.array_max(m) > 0, F.lit(False)) for m in masks])
    return stacked.select("raw_file", "ping_idx", F.when(some, F.transform(unset, label)).otherwise(unset).alias("labels"))


def category_layers(labels: DataFrame, categories: Sequence[int]) -> DataFrame:
    """Label arrays -> one 0/1 mask per ping and category."""
    rows = labels.select("raw_file", "ping_idx", "labels", F.explode(F.array(*map(F.lit, categories))).alias("category"))
    return rows.select("raw_file", "ping_idx", "category", F.expr("transform(labels, x -> int(x = category))").alias("mask"))


def padded(profile: Column | str, n: Column | int, value) -> Column:
    """A profile filled up with `value` to n bins."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(profile, F.array_repeat(F.lit(value), F.greatest(n - F.size(profile), F.lit(0)).cast("int")))


def longest_profiles(sv: DataFrame) -> DataFrame:
    """survey, __n: the length of each survey's longest profile."""
    return sv.groupBy("survey").agg(F.max(F.size("sv")).alias("__n"))


def pad_to_survey(sv: DataFrame, value: float = NAN, longest: DataFrame | None = None) -> DataFrame:
    """All profiles of a survey padded to its longest (default that of sv); the maximum is one row per survey and broadcast, so profiles stay where they are."""
    longest = longest_profiles(sv) if longest is None else longest
    return sv.join(F.broadcast(longest), "survey").withColumn("sv", padded("sv", F.col("__n"), value)).drop("__n")


def seabed_from_mask(mask: Column | str) -> Column:
    """Index of the first 1, or 0 without a bottom."""
    return F.greatest(F.array_position(mask, 1) - 1, F.lit(0)).cast("int")


def seabed_mask(seabed: Column, lo: int, hi: int, pad: int = 0) -> Column:
    """1 at and below seabed + pad for range bins lo .. hi - 1."""
    return F.transform(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda r: (r >= seabed + pad).cast("int"))


def grid_offsets(size: int) -> range:
    return range(-((size + 1) // 2) + 1, size // 2 + 1)


def patch_to_data(p: Column, centre: Column, size: int) -> Column:
    return p + centre - size // 2 + 1


def crops(patches: DataFrame, rows: DataFrame, column: str, height: int, width: int, fill, freqs: Sequence[int] = ()) -> DataFrame:
    """Windows around patches(raw_file, patch_id, cy, cx): one row per patch column x with its `height` cells.

    Cells outside the data hold `fill`. The patch side is exploded to its ping indices and
    equi-joined, so a crop reads the pings it covers only. Rows with freq_hz need the list of
    their frequencies: each patch column comes back once for each of them.
    """
    cols = patches.select("raw_file", "patch_id", "cy", "cx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    cols = cols.withColumn("ping_idx", patch_to_data(F.col("x"), F.col("cx"), width).cast("int"))
    keys = ["raw_file", "ping_idx"]
    if "freq_hz" in rows.columns:
        if not freqs:
            raise ValueError("rows of several frequencies need their list")
        cols = cols.withColumn("freq_hz", F.explode(F.array(*map(F.lit, freqs))))
        keys.append("freq_hz")
    data = rows.select(*keys, F.col(column).alias("__v"))
    joined = cols.join(data.hint("merge"), keys, "left")
    return joined.select(*keys, "patch_id", "cy", "cx", "x", cropped(F.col("__v"), F.col("cy"), height, fill).alias(column))


def cropped(profile: Column, cy: Column, height: int, fill) -> Column:
    """The `height` cells of a profile around the range bin cy; `fill` outside of it."""
    top = patch_to_data(F.lit(0), cy, height)
    return F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.coalesce(F.when(top + y >= 0, F.get(profile, (top + y).cast("int"))), F.lit(fill)))


def tiles(files: DataFrame, seabed: DataFrame, patch: int, overlap: int, margin: int = 50) -> DataFrame:
    """Grid of patch centres over files(raw_file, n_pings, n_range): raw_file, patch_id, cy, cx.

    Interiors (a patch without its overlap) tile the file. Range is limited to the deepest seabed plus margin.
    """
    deepest = seabed.groupBy("raw_file").agg(F.max("seabed_idx").alias("__deep"))
    step, first = patch - 2 * overlap, -(overlap + 1)
    limit = F.least(F.col("n_range"), F.coalesce(F.col("__deep") + margin, F.col("n_range")))
    along = lambda n: F.sequence(F.lit(first), F.greatest(n - 1, F.lit(0)) + first, F.lit(step))
    grid = files.join(deepest, "raw_file", "left").filter("n_pings > 0").select("raw_file", F.explode(along(F.col("n_pings"))).alias("ux"), limit.alias("__lim"))
    grid = grid.select("raw_file", "ux", F.explode(along(F.col("__lim"))).alias("uy"))
    ident = F.concat_ws(":", "raw_file", F.col("uy") + patch // 2, F.col("ux") + patch // 2)
    return grid.select("raw_file", ident.alias("patch_id"), (F.col("uy") + patch // 2).alias("cy"), (F.col("ux") + patch // 2).alias("cx"))


def tiles_at_objects(grid: DataFrame, objects: DataFrame, trace: bool = False) -> DataFrame:
    """Tiles of grid(tiles) whose centre is nearest to an object's two ping edges, and range edges unless trace; each tile once.

    Centres are evenly spaced, so the nearest one is reckoned from the first, the last and the number of
    centres of a file (the first of two equally near ones); no object meets a tile.
    """
    axes = grid.groupBy("raw_file").agg(*[f(c).alias(f"__{c}_{n}") for c in ("cx", "cy") for f, n in ((F.min, "lo"), (F.max, "hi"), (F.count_distinct, "n"))])

    def nearest(axis: str, edge: str) -> Column:
        lo, hi, n = (F.col(f"__{axis}_{k}") for k in ("lo", "hi", "n"))
        step = F.when(n > 1, ((hi - lo) / (n - 1)).cast("int")).otherwise(F.lit(1))
        k = F.ceil((F.col(edge) - lo) / step - 0.5)
        return (lo + step * F.greatest(F.lit(0), F.least(n - 1, k))).cast("int")

    ys = F.array(nearest("cy", "y0"), nearest("cy", "y1"))
    if trace:
        ys = F.when(F.col("__cy_n") > 1, F.sequence(F.col("__cy_lo"), F.col("__cy_hi"), ((F.col("__cy_hi") - F.col("__cy_lo")) / (F.col("__cy_n") - 1)).cast("int"))).otherwise(F.array("__cy_lo"))
    near = objects.join(axes, "raw_file").select("raw_file", F.explode(F.array_distinct(F.array(nearest("cx", "x0"), nearest("cx", "x1")))).alias("cx"), ys.alias("ys"))
    chosen = near.select("raw_file", "cx", F.explode("ys").alias("cy")).distinct()
    return grid.join(chosen.hint("merge"), ["raw_file", "cx", "cy"], "left_semi")


def split_ranges(ranges: DataFrame, max_n: int) -> DataFrame:
    """ranges(start, stop) cut into the fewest pieces of at most max_n with equally spaced, truncated edges."""
    n = F.greatest(F.ceil((F.col("stop") - F.col("start")) / F.lit(float(max_n))), F.lit(1)).cast("int")
    # a file of a million pings has more pings times pieces than an int holds
    edge = lambda i: F.expr(f"cast(start + cast({i} as bigint) * (stop - start) / n as int)")
    rows = ranges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.withColumn("lo", edge("i")).withColumn("hi", edge("(i + 1)")).drop("n", "i")


def nearest_sample(points: DataFrame, rows: DataFrame, column: str, fill) -> DataFrame:
    """points(raw_file, y, x) -> value at the truncated coordinate, `fill` outside the data."""
    at = points.withColumn("ping_idx", F.when(F.col("x") > -1, F.col("x").cast("int"))).withColumn("__y", F.col("y").cast("int"))
    got = at.join(rows.select("raw_file", "ping_idx", F.col(column).alias("__v")), ["raw_file", "ping_idx"], "left")
    value = F.when(F.col("y") > -1, F.get("__v", F.col("__y")))
    return got.withColumn("value", F.coalesce(value, F.lit(fill))).drop("__v", "__y", "ping_idx")


def bilinear_sample(points: DataFrame, rows: DataFrame, column: str, fill) -> DataFrame:
    """points(point_id, raw_file, y, x) -> value interpolated from the four neighbours, `fill` unless all are in the data."""
    y0, x0 = F.floor("y").cast("int"), F.floor("x").cast("int")
    fy, fx = F.col("y") - y0, F.col("x") - x0
    corners = F.array(*[F.struct((x0 + dx).alias("ping_idx"), (y0 + dy).alias("r"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w")) for dy in (0, 1) for dx in (0, 1)])
    each = points.select("point_id", "raw_file", F.explode(corners).alias("c")).select("point_id", "raw_file", "c.*")
    got = each.join(rows.select("raw_file", "ping_idx", F.col(column).alias("__v")), ["raw_file", "ping_idx"], "left")
    v = F.when(F.col("r") >= 0, F.get("__v", F.col("r")))
    out = got.withColumn("v", v).groupBy("point_id").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.count("v").alias("n"))
    return points.join(out, "point_id", "left").withColumn("value", F.when(F.col("n") == 4, F.col("s")).otherwise(F.lit(fill))).drop("s", "n")


def rotated(y: Column, x: Column, theta: float) -> tuple[Column, Column]:
    """Grid coordinates turned by theta."""
    c, s = F.cos(F.lit(theta)), F.sin(F.lit(theta))
    return y * c - x * s, y * s + x * c


def mask_coordinates(rows: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """by, raw_file, ping_idx, r of the cells where the mask is positive."""
    return rows.select(*by, "raw_file", "ping_idx", F.posexplode(column).alias("r", "m")).filter("m > 0").drop("m")


def nearest_bin(value: Column, ranges: Sequence[float]) -> Column:
    """Index of the nearest range, the first on a tie."""
    steps = F.array(*[F.struct(F.abs(value - F.lit(float(r))).alias("d"), F.lit(i).alias("i")) for i, r in enumerate(ranges)])
    return F.array_min(steps)["i"]


def label_boundary(labels: Column | str) -> Column:
    """Labels with missing cells as IGNORE."""
    return F.transform(labels, lambda y: F.coalesce(y, F.lit(IGNORE)))
