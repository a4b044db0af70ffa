"""Sampling of patch centres and splits, with keyed uniform numbers instead of a random state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.acoustic import keyed_uniform
from .blocks import ranked

#: The mixture of samplers and their weights.
MIXTURE = (("background", 1), ("seabed", 5), ("school_27", 5), ("school_1", 5), ("school_seabed_27", 5), ("school_seabed_1", 5))
#: Survey years of the evaluation set "all".
EVALUATION_YEARS = (2007, 2008, 2009, 2010, 2011, 2013, 2014, 2015, 2016, 2017, 2018)


def mixture_draws(draws: DataFrame, seed: int, mixture: Sequence[tuple[str, int]] = MIXTURE) -> DataFrame:
    """draws(draw_id) with sampler: a keyed uniform falls into the cumulative weights."""
    total, edge, out = sum(w for _, w in mixture), 0, None
    u = keyed_uniform(F.col("draw_id"), seed)
    for name, weight in mixture[:-1]:
        edge += weight
        cond = u < edge / total
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return draws.withColumn("sampler", out.otherwise(mixture[-1][0]))


def jitter(u: Column, size: int) -> Column:
    """A whole number between minus and plus half of an even size, both included."""
    return F.floor(u * (size + 1)) - size // 2


def seabed_centres(pings: DataFrame, seed: int, height: int) -> DataFrame:
    """pings(raw_file, ping_idx, key, seabed_idx) -> raw_file, cy, cx: a centre within half a window of the seabed."""
    u = keyed_uniform(F.col("key"), seed)
    return pings.filter("seabed_idx > 0").select("raw_file", (F.col("seabed_idx") + jitter(u, height)).cast("int").alias("cy"), F.col("ping_idx").alias("cx"))


def background_centres(pings: DataFrame, seed: int, height: int) -> DataFrame:
    """pings(raw_file, ping_idx, key, seabed_idx) -> a centre between the surface and half a window above the seabed."""
    u = keyed_uniform(F.col("key"), seed)
    room = F.col("seabed_idx") - height // 2
    return pings.filter(room > 0).select("raw_file", F.floor(u * room).cast("int").alias("cy"), F.col("ping_idx").alias("cx"))


def without_labels(centres: DataFrame, boxes: DataFrame, height: int, width: int) -> DataFrame:
    """Centres whose window holds no labelled cell of boxes(raw_file, x0, x1, y0, y1); no rejection loop.

    Boxes grown by the window are exploded to pings, so the test is an equi-join.
    """
    reach = boxes.select("raw_file", F.explode(F.sequence(F.col("x0") - width // 2, F.col("x1") + (width - 1) // 2 + 1)).alias("cx"), (F.col("y0") - height // 2).alias("__lo"), (F.col("y1") + (height - 1) // 2 + 1).alias("__hi"))
    bad = (centres.raw_file == reach.raw_file) & (centres.cx == reach.cx) & (centres.cy >= reach["__lo"]) & (centres.cy <= reach["__hi"])
    return centres.join(reach, bad, "left_anti")


def school_centres(objects: DataFrame, seed: int, height: int, width: int, max_distance: float | None = None) -> DataFrame:
    """One centre per valid object: a uniform cell of its box (degenerate sides widened by 1) with half a window of jitter.

    max_distance keeps the objects nearer than that to the seabed.
    """
    rows = objects.filter("valid_object")
    if max_distance is not None:
        rows = rows.filter(F.col("distance_to_seabed") < max_distance)
    u = [keyed_uniform(F.col("object_id"), seed + i) for i in range(4)]
    pick = lambda lo, hi, a: F.floor(lo + a * F.greatest(hi - lo, F.lit(1)))
    cy = pick(F.col("y0"), F.col("y1"), u[0]) + jitter(u[2], height)
    cx = pick(F.col("x0"), F.col("x1"), u[1]) + jitter(u[3], width)
    return rows.select("raw_file", "object_id", cy.cast("int").alias("cy"), cx.cast("int").alias("cx"))


POOL = ("sampler", "raw_file", "key", "x0", "x1", "y0", "y1", "jitter_x", "jitter_y")


def pools(pings: DataFrame, objects: DataFrame, boxes: DataFrame, seed: int, height: int, width: int, categories: Sequence[int] = (27, 1)) -> DataFrame:
    """The candidates of all samplers of MIXTURE: a cell range (x1, y1 exclusive) and how far a draw may move from it.

    background: clear centres above the seabed, one of each ping. seabed: pings with a seabed. school_c:
    valid objects(raw_file, object_id, x0 .. y1, category, distance_to_seabed) of the category. school_seabed_c: those
    nearer than half a window to the seabed. boxes: what a background window must not touch.
    """

    def rows(df: DataFrame, name: Column | str, key: str, x0, x1, y0, y1, jx: int, jy: int) -> DataFrame:
        name = F.lit(name) if isinstance(name, str) else name
        cols = [name, F.col("raw_file"), F.col(key).cast("long"), *(c.cast("int") for c in (x0, x1, y0, y1)), F.lit(jx), F.lit(jy)]
        return df.select(*[c.alias(n) for c, n in zip(cols, POOL, strict=True)])

    clear = without_labels(background_centres(pings, seed, height), boxes, height, width).join(pings.select("raw_file", F.col("ping_idx").alias("cx"), "key"), ["raw_file", "cx"])
    x, y = F.col("cx"), F.col("cy")
    out = rows(clear, "background", "key", x, x + 1, y, y + 1, 0, 0)
    x, y = F.col("ping_idx"), F.col("seabed_idx")
    out = out.unionByName(rows(pings.filter("seabed_idx > 0"), "seabed", "key", x, x + 1, y, y + 1, 0, height))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    found = objects.filter(F.col("valid_object") & F.col("category").isin(list(categories)))
    kinds = F.array_compact(F.array(F.concat(F.lit("school_"), F.col("category")), F.when(F.col("distance_to_seabed") < height // 2, F.concat(F.lit("school_seabed_"), F.col("category")))))
    found = found.withColumn("__kind", F.explode(kinds))
    return out.unionByName(rows(found, F.col("__kind"), "object_id", x0, F.greatest(x1, x0 + 1), y0, F.greatest(y1, y0 + 1), width, height))


def drawn_centres(draws: DataFrame, pool: DataFrame, seed: int, mixture: Sequence[tuple[str, int]] = MIXTURE) -> DataFrame:
    """draws(draw_id) -> draw_id, sampler, raw_file, key, cy, cx: each draw takes a candidate of its sampler, all equally likely.

    Candidates are ranked in the order of raw_file and key over ranges of the pool, and a draw looks its
    rank up, so the work is one join on (sampler, rank) however large the pool; only the sizes
    of the pools, one for each sampler, are joined to all draws. All numbers depend on seed and
    draw_id only. Draws whose sampler has no candidate have nulls.
    """
    placed = ranked(pool.select(*POOL), ["sampler"], ["raw_file", "key"])
    sizes = pool.groupBy("sampler").agg(F.count("*").alias("__n"))
    u = [keyed_uniform(F.col("draw_id"), seed + i) for i in range(1, 6)]
    told = mixture_draws(draws, seed, mixture).join(sizes, "sampler", "left").withColumn("rank", F.floor(u[0] * F.col("__n")))
    cell = lambda lo, hi, a, b, size: F.col(lo) + F.floor(a * (F.col(hi) - F.col(lo))) + F.floor(b * (F.col(size) + 1)) - F.floor(F.col(size) / 2)
    cx, cy = cell("x0", "x1", u[1], u[2], "jitter_x"), cell("y0", "y1", u[3], u[4], "jitter_y")
    return told.join(placed, ["sampler", "rank"], "left").select("draw_id", "sampler", "raw_file", "key", cy.cast("int").alias("cy"), cx.cast("int").alias("cx"))


def window_with_point(y: Column, n: Column | int, size: int, u: Column, slack: int = 20) -> Column:
    """A window centre that contains y at least `slack` from the window's edge, and reaches beyond n bins by `slack` at most; the middle of small data."""
    n = F.lit(n) if isinstance(n, int) else n
    half = size // 2 - slack
    lo, hi = F.greatest(F.lit(half), y - half), F.least(n - half, y + half)
    return F.when(n <= size, F.floor(n / 2)).otherwise(F.floor(F.least(lo, hi) + u * F.greatest(hi - lo, F.lit(0)))).cast("int")


def first_by_hash(pool: DataFrame, by: Sequence[str], key: Column, seed: int, n: int) -> DataFrame:
    """n rows of each group in the order of a keyed uniform."""
    order = Window.partitionBy(*by).orderBy(keyed_uniform(key, seed), key)
    return pool.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def train_test_split(files: DataFrame, seed: int, share: float = 0.85) -> DataFrame:
    """files(file_id, ...) with split train or test: the share of smallest keyed uniforms trains."""
    rank = F.percent_rank().over(Window.partitionBy(F.lit(0)).orderBy(keyed_uniform(F.col("file_id"), seed), "file_id"))
    return files.withColumn("split", F.when(rank < share, "train").otherwise("test"))


def split_by_years(files: DataFrame, train: Sequence[int], test: Sequence[int]) -> DataFrame:
    """survey files by split; a file may stand in both."""
    part = lambda years, name: files.filter(F.col("survey").isin(list(years))).withColumn("split", F.lit(name))
    return part(train, "train").unionByName(part(test, "test"))


def noisy(value: Column, cell_key: Column, patch_key: Column, seed: int, share: float = 0.05) -> Column:
    """Noise augmentation: with probability 1/2 per patch, `share` of the cells are multiplied by U(1, 10) or U(0, 1), half each."""
    on = keyed_uniform(patch_key, seed) < 0.5
    u = keyed_uniform(cell_key, seed + 1)
    v = keyed_uniform(cell_key, seed + 2)
    return F.when(on & (u < share / 2), value * (1 + 9 * v)).when(on & (u < share), value * v).otherwise(value)


def flipped(x: Column, patch_key: Column, seed: int, width: int) -> Column:
    """Flip along pings with probability 1/2 per patch."""
    return F.when(keyed_uniform(patch_key, seed) < 0.5, width - 1 - x).otherwise(x)
