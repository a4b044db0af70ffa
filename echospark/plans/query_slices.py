"""Queries of slices, crops and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slices as S
from ..sources.fixtures import CATEGORIES, Survey
from .queries import labelled, query


@query(
    "b1_box_slice",
    "raw_file:s freq_hz:i total:d n:i",
    """SELECT raw_file, f * 1000 AS freq_hz, sum(CASE WHEN isnan(v) THEN 0 ELSE v END) AS total, count(*) AS n FROM sv
       WHERE f IN (38, 200) AND ping_idx >= 20 AND ping_idx < 80 AND r >= 5 AND r < 30 GROUP BY ALL""",
)
def box_slice(v: Survey) -> DataFrame:
    rows = S.box_slice(v.sv, (38000, 200000), (20, 80), (5, 30))
    return rows.groupBy("raw_file", "freq_hz").agg(F.sum(F.aggregate("sv", F.lit(0.0), lambda a, x: a + F.when(F.isnan(x), 0.0).otherwise(x))).alias("total"), F.sum(F.size("sv")).alias("n"))


@query("b1_complete_bins", "raw_file:s r:i", "SELECT raw_file, r FROM sv GROUP BY ALL HAVING NOT bool_or(isnan(v) AND r % 2 = 1)")
def complete_bins(v: Survey) -> DataFrame:
    """Every second bin is filled, so that some are complete over all pings and frequencies."""
    return S.complete_bins(v.sv.withColumn("sv", F.transform("sv", lambda x, r: F.when(r % 2 == 0, F.nanvl(x, F.lit(0.0))).otherwise(x))))


@query(
    "b2_raw_file_slice",
    "raw_file:s first_ping:i n_pings:i freqs:i cells:i labelled:i deepest:i",
    """SELECT raw_file, min(ping_idx) AS first_ping, count(DISTINCT ping_idx) AS n_pings, count(DISTINCT f) AS freqs, count(*) AS cells, sum((label > 0 AND f = 18)::INT) AS labelled, max(b) AS deepest
       FROM sv JOIN (SELECT raw_file, ping_idx, r, label FROM label) USING (raw_file, ping_idx, r) WHERE raw_file IN ('2024-01-03', '2024-01-17') GROUP BY ALL""",
)
def raw_file_slice(v: Survey) -> DataFrame:
    """Index, data, labels and seabed of two raw files."""
    got = S.raw_file_slice(["2024-01-03", "2024-01-17"], v.sv, labelled(v), v.seabed)
    cells = got.groupBy("raw_file").agg(
        F.min("ping_idx").alias("first_ping"),
        F.count_distinct("ping_idx").alias("n_pings"),
        F.count_distinct("freq_hz").alias("freqs"),
        F.sum(F.size("sv")).alias("cells"),
        F.sum(F.when(F.col("freq_hz") == 18000, F.size(F.filter("labels", lambda y: y > 0)))).alias("labelled"),
        F.max("seabed_idx").alias("deepest"),
    )
    return cells


@query("b3_merged_labels", "raw_file:s label:i n:i", "SELECT raw_file, label, count(*) AS n FROM label GROUP BY ALL")
def merged_labels(v: Survey) -> DataFrame:
    return labelled(v).select("raw_file", F.explode("labels").alias("label")).groupBy("raw_file", "label").agg(F.count("*").alias("n"))


@query("b4_category_layers", "raw_file:s category:i n:i", "SELECT raw_file, category, sum((label = category)::INT) AS n FROM label, (SELECT unnest([-1, 1, 27, 6009]) AS category) GROUP BY ALL")
def category_layers(v: Survey) -> DataFrame:
    layers = S.category_layers(labelled(v), (-1, *CATEGORIES))
    return layers.groupBy("raw_file", "category").agg(F.sum(F.aggregate("mask", F.lit(0), lambda a, m: a + m)).alias("n"))


@query(
    "b5_padded_profiles",
    "survey:i raw_file:s freq_hz:i n_bins:i missing:i",
    """SELECT survey, raw_file, f * 1000 AS freq_hz, count(*) * max(w) AS n_bins, sum(w - n) AS missing FROM (SELECT *, max(n) OVER (PARTITION BY survey) AS w FROM
       (SELECT survey, raw_file, f, 50 + (e + f) % 11 AS n FROM ping, freq)) GROUP BY ALL""",
)
def padded_profiles(v: Survey) -> DataFrame:
    rows = v.sv.withColumn("sv", F.expr("transform(slice(sv, 1, int(50 + (e + freq_hz div 1000) % 11)), x -> nanvl(x, double(0)))"))
    padded = S.pad_to_survey(rows)
    return padded.groupBy("survey", "raw_file", "freq_hz").agg(F.sum(F.size("sv")).alias("n_bins"), F.sum(F.size(F.filter("sv", lambda x: F.isnan(x)))).alias("missing"))


@query("b6_b7_seabed_masks", "raw_file:s ping_idx:i line:i below:i", "SELECT raw_file, ping_idx, b AS line, 64 - greatest(b + 4, 10) AS below FROM ping")
def seabed_masks(v: Survey) -> DataFrame:
    mask = S.seabed_mask(F.col("seabed_idx"), 0, 64)
    deep = S.seabed_mask(F.col("seabed_idx"), 10, 64, pad=4)
    return v.seabed.select("raw_file", "ping_idx", S.seabed_from_mask(mask).alias("line"), F.aggregate(deep, F.lit(0), lambda a, m: a + m).alias("below"))


_PATCH = """pt AS (SELECT raw_file, object_id AS patch_id, (y0 + y1) // 2 AS cy, x0 AS cx FROM school),
pc AS (SELECT raw_file, patch_id, cy, cx, x, y, x + cx - 16 + 1 AS ping_idx, y + cy - 16 + 1 AS r FROM pt, (SELECT unnest(range(32)) AS x), (SELECT unnest(range(32)) AS y))"""


@query(
    "b8_crops",
    "patch_id:i outside:i labelled:i weight:i",
    """SELECT patch_id, sum((label IS NULL)::INT) AS outside, sum((coalesce(label, -100) > 0)::INT) AS labelled, sum(coalesce(label, -100) * (x * 32 + y)) AS weight
       FROM pc LEFT JOIN label USING (raw_file, ping_idx, r) GROUP BY ALL""",
    _PATCH,
)
def crops(v: Survey) -> DataFrame:
    patches = v.school.select("raw_file", F.col("object_id").alias("patch_id"), F.expr("(y0 + y1) div 2").cast("int").alias("cy"), F.col("x0").alias("cx"))
    cols = S.crops(patches, labelled(v), "labels", 32, 32, -100)
    total = lambda f: F.aggregate(f, F.lit(0).cast("bigint"), lambda a, y: a + y)
    return cols.groupBy("patch_id").agg(
        F.sum(F.size(F.filter("labels", lambda y: y == -100))).alias("outside"),
        F.sum(F.size(F.filter("labels", lambda y: y > 0))).alias("labelled"),
        F.sum(total(F.transform("labels", lambda y, i: (y * (F.col("x") * 32 + i)).cast("bigint")))).alias("weight"),
    )


_STEP = 24
_TILES = """lim AS (SELECT raw_file, count(*) AS n, least(64, max(b) + 5) AS h FROM ping GROUP BY ALL),
tile AS (SELECT raw_file, i * 24 - 5 + 16 AS cx, j * 24 - 5 + 16 AS cy FROM (SELECT *, unnest(range((n - 1) // 24 + 1)) AS i FROM lim), (SELECT unnest(range(10)) AS j) WHERE j * 24 <= h - 1)"""


def grid(v: Survey) -> DataFrame:
    return S.tiles(v.file, v.seabed, 32, 4, margin=5)


@query("b11_b13_tiles", "raw_file:s cy:i cx:i", "SELECT raw_file, cy, cx FROM tile", _TILES)
def tiles(v: Survey) -> DataFrame:
    return grid(v)


@query(
    "b11_tiles_partition",
    "raw_file:s cells:i covered:i",
    "SELECT raw_file, n * h AS cells, n * h AS covered FROM lim",
    _TILES,
)
def tiles_partition(v: Survey) -> DataFrame:
    """Tile interiors cover every cell of the file exactly once."""
    inner = lambda c: F.explode(F.sequence(F.col(c) - 16 + 1 + 4, F.col(c) - 16 + 1 + 27))
    g = grid(v)
    along = lambda c: g.select("raw_file", c).distinct().select("raw_file", inner(c).alias("p")).groupBy("raw_file", "p").count()
    size = v.file.join(v.seabed.groupBy("raw_file").agg(F.least(F.lit(64), F.max("seabed_idx") + 5).alias("h")), "raw_file")
    count = lambda c, n: along(c).join(size, "raw_file").filter(f"p >= 0 and p < {n}").groupBy("raw_file").agg(F.sum("count").alias(c))
    return size.join(count("cx", "n_pings"), "raw_file").join(count("cy", "h"), "raw_file").select("raw_file", (F.col("n_pings") * F.col("h")).alias("cells"), (F.col("cx") * F.col("cy")).alias("covered"))


@query(
    "b12_region_tiles",
    "raw_file:s cy:i cx:i",
    """SELECT DISTINCT raw_file, cy, cx FROM (SELECT raw_file, object_id, unnest(xs) AS cx FROM (SELECT s.raw_file, object_id, [arg_min(cx, (abs(cx - x0), cx)), arg_min(cx, (abs(cx - x1), cx))] AS xs FROM school s JOIN (SELECT DISTINCT raw_file, cx FROM tile) t ON s.raw_file = t.raw_file WHERE x0 <= x1 AND category <> -1 GROUP BY 1, 2)) a
       JOIN (SELECT raw_file, object_id, unnest(ys) AS cy FROM (SELECT s.raw_file, object_id, [arg_min(cy, (abs(cy - y0), cy)), arg_min(cy, (abs(cy - y1), cy))] AS ys FROM school s JOIN (SELECT DISTINCT raw_file, cy FROM tile) t ON s.raw_file = t.raw_file WHERE x0 <= x1 AND category <> -1 GROUP BY 1, 2)) b USING (raw_file, object_id)""",
    _TILES,
)
def region_tiles(v: Survey) -> DataFrame:
    return S.tiles_at_objects(grid(v), v.school.filter("x0 <= x1 and category <> -1"))


@query(
    "b12_trace_tiles",
    "raw_file:s cy:i cx:i",
    """SELECT DISTINCT raw_file, cy, cx FROM (SELECT raw_file, object_id, unnest(xs) AS cx FROM (SELECT s.raw_file, object_id, [arg_min(cx, (abs(cx - x0), cx)), arg_min(cx, (abs(cx - x1), cx))] AS xs FROM school s JOIN (SELECT DISTINCT raw_file, cx FROM tile) t ON s.raw_file = t.raw_file WHERE x0 <= x1 AND category <> -1 GROUP BY 1, 2)) a
       JOIN (SELECT DISTINCT raw_file, cy FROM tile) b USING (raw_file)""",
    _TILES,
)
def trace_tiles(v: Survey) -> DataFrame:
    return S.tiles_at_objects(grid(v), v.school.filter("x0 <= x1 and category <> -1"), trace=True)


@query(
    "b14_split_ranges",
    "raw_file:s lo:i hi:i",
    """SELECT raw_file, floor(10 + i * (n - 10) / m) AS lo, floor(10 + (i + 1) * (n - 10) / m) AS hi FROM (SELECT *, unnest(range(m::BIGINT)) AS i FROM (SELECT raw_file, n_pings AS n, greatest(ceil((n_pings - 10) / 70.0), 1) AS m FROM file))""",
)
def split_ranges(v: Survey) -> DataFrame:
    return S.split_ranges(v.file.select("raw_file", F.lit(10).alias("start"), F.col("n_pings").alias("stop")), 70)


_POINTS = "SELECT e AS point_id, raw_file, (e % 700) / 10.0::DOUBLE - 2 AS y, ping_idx + (e % 7) / 8.0::DOUBLE - 0.5 AS x FROM ping"


def points(v: Survey) -> DataFrame:
    return v.ping.select(F.col("e").alias("point_id"), "raw_file", ((F.col("e") % 700) / 10.0 - 2).alias("y"), (F.col("ping_idx") + (F.col("e") % 7) / 8.0 - 0.5).alias("x"))


@query(
    "b15_nearest_sample",
    "point_id:i value:d",
    """SELECT point_id, coalesce(p, -100) AS value FROM pt LEFT JOIN pred ON pred.raw_file = pt.raw_file AND y > -1 AND x > -1 AND pred.ping_idx = trunc(x) AND pred.r = trunc(y)""",
    f"pt AS ({_POINTS})",
)
def nearest_sample(v: Survey) -> DataFrame:
    return S.nearest_sample(points(v), v.pred, "p_sandeel", -100.0)


@query(
    "b16_bilinear_sample",
    "point_id:i value:d",
    """SELECT point_id, CASE WHEN count(p) = 4 THEN sum(p * w) ELSE -100 END AS value FROM (SELECT *, floor(y) + dy AS yy, floor(x) + dx AS xx,
       (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM pt, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)) c
       LEFT JOIN pred ON pred.raw_file = c.raw_file AND pred.ping_idx = xx AND pred.r = yy GROUP BY ALL""",
    f"pt AS ({_POINTS})",
)
def bilinear_sample(v: Survey) -> DataFrame:
    return S.bilinear_sample(points(v), v.pred, "p_sandeel", -100.0)


@query("b9_b17_rotated_grid", "point_id:i y:d x:d", f"SELECT point_id, y * cos(0.3) - x * sin(0.3) AS y, y * sin(0.3) + x * cos(0.3) AS x FROM ({_POINTS})")
def rotated_grid(v: Survey) -> DataFrame:
    y, x = S.rotated(F.col("y"), F.col("x"), 0.3)
    return points(v).select("point_id", y.alias("y"), x.alias("x"))


@query("b18_mask_coordinates", "category:i raw_file:s ping_idx:i r:i", "SELECT category, raw_file, ping_idx, r FROM lay")
def mask_coordinates(v: Survey) -> DataFrame:
    return S.mask_coordinates(v.annotation, "mask", ["category"])


@query("b19_d2_nearest_bin", "raw_file:s ping_idx:i bin:i", "SELECT raw_file, ping_idx, least(greatest(ceil((e % 400) / 10.0 / 0.5 - 1 - 0.5), 0), 63) AS bin FROM ping")
def nearest_bin(v: Survey) -> DataFrame:
    return v.ping.select("raw_file", "ping_idx", S.nearest_bin((F.col("e") % 400) / 10.0, [0.5 * (r + 1) for r in range(64)]).alias("bin"))
