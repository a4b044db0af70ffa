"""Queries of joins and label transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import labels as L
from ..sources.fixtures import Survey
from .queries import labelled, query

_DISTANCE = """obj AS (SELECT s.*, x0 <= x1 AND category <> -1 AS valid, CASE WHEN x0 <= x1 AND category <> -1 THEN (p.b - y1)::DOUBLE END AS distance
  FROM school s LEFT JOIN ping p ON p.raw_file = s.raw_file AND p.ping_idx = x0 + trunc((x1 - x0) / 2.0)::INT)"""


def objects(v: Survey) -> DataFrame:
    return J.objects_with_seabed(v.school, v.seabed)


@query(
    "d1_nearest_ping",
    "raw_file:s query_id:i ping_idx:i",
    """SELECT q.raw_file, query_id, arg_min(ping_idx, (abs(epoch_us(ping_time) - epoch_us(time)), ping_time, ping_idx)) AS ping_idx FROM (SELECT raw_file, ping_number AS query_id, time FROM ext_mask) q JOIN ping p ON p.raw_file = q.raw_file GROUP BY ALL""",
)
def nearest_ping(v: Survey) -> DataFrame:
    return J.nearest_in_time(v.ext_mask.select("raw_file", F.col("ping_number").alias("query_id"), "time"), v.ping)


@query(
    "d3_nearest_position",
    "point_id:i ping_id:i",
    """SELECT a.e AS point_id, arg_min(b.e, (pow(b.lat - (a.lat + 0.0004 + CASE WHEN e_far THEN 1.5 ELSE 0 END), 2) + pow(b.lon - (a.lon - 0.0003), 2), b.e)) AS ping_id FROM (SELECT *, e % 100 = 0 AS e_far FROM ping WHERE e % 20 = 0) a, ping b GROUP BY ALL""",
)
def nearest_position(v: Survey) -> DataFrame:
    """Points beside the pings, every fifth far north of where they are dense."""
    far = F.when(F.col("e") % 100 == 0, 1.5).otherwise(0.0)
    points = v.ping.filter("e % 20 = 0").select(F.col("e").alias("point_id"), (F.col("lat") + 0.0004 + far).alias("lat"), (F.col("lon") - 0.0003).alias("lon"))
    return J.nearest_position(points, v.ping.select(F.col("e").alias("ping_id"), "lat", "lon"), 0.02)


@query("d0_d4_valid_pings", "raw_file:s ping_idx:i n:i", "SELECT p.raw_file, ping_idx, count(*) AS n FROM ping p JOIN transect t ON p.raw_file = t.raw_file AND ping_time BETWEEN t0 AND t1 GROUP BY ALL")
def valid_pings(v: Survey) -> DataFrame:
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    pings = v.ping.select("raw_file", "ping_idx", seconds("ping_time").alias("t"))
    spans = v.transect.select("raw_file", seconds("start_time").alias("lo"), seconds("stop_time").alias("hi"))
    return J.point_in_interval(pings, spans, "raw_file", "t", "lo", "hi", 20 * 60e6).groupBy("raw_file", "ping_idx").agg(F.count("*").alias("n"))


@query("d5_objects_with_seabed", "object_id:i distance:d valid:b", "SELECT object_id, distance, valid FROM obj", _DISTANCE)
def objects_with_seabed(v: Survey) -> DataFrame:
    return objects(v).select("object_id", F.col("distance_to_seabed").alias("distance"), F.col("valid_object").alias("valid"))


@query("d6_e2_schools", "category:i n:i", "SELECT category, count(*) AS n FROM obj WHERE valid GROUP BY ALL", _DISTANCE)
def schools(v: Survey) -> DataFrame:
    return J.fish_schools(objects(v)).groupBy("category").agg(F.count("*").alias("n"))


_FORWARD = """fw AS (SELECT m.raw_file, ping_number, min_m, max_m, min(p.ping_idx) AS ping_idx FROM ext_mask m JOIN ping p ON p.raw_file = m.raw_file AND p.ping_time >= m.time
  WHERE m.time >= (SELECT min(ping_time) FROM ping x WHERE x.raw_file = m.raw_file) GROUP BY ALL)"""


@query("d7_first_ping_after", "raw_file:s query_id:i ping_idx:i", "SELECT raw_file, ping_number AS query_id, ping_idx FROM fw", _FORWARD)
def first_ping_after(v: Survey) -> DataFrame:
    return J.first_at_or_after(v.ext_mask.select("raw_file", F.col("ping_number").alias("query_id"), "time"), v.ping)


@query(
    "d8_m7_external_labels",
    "raw_file:s ping_idx:i r:i n:i",
    """SELECT raw_file, ping_idx, r - h AS r, count(*) AS n FROM (SELECT fw.*, rng.r, (SELECT round_even(heave_m / 0.5, 0)::INT FROM ping p WHERE p.raw_file = fw.raw_file AND p.ping_idx = fw.ping_idx) AS h
       FROM fw, rng WHERE 0.5 * (r + 1) > min_m - 2 AND 0.5 * (r + 1) <= max_m - 2) WHERE r - h BETWEEN 0 AND 63 GROUP BY ALL""",
    _FORWARD,
)
def external_labels(v: Survey) -> DataFrame:
    """External mask -> first ping -> depth bins -> heave shift."""
    masks = v.ext_mask.withColumn("query_id", F.col("ping_number"))
    hit = J.first_at_or_after(masks.select("raw_file", "query_id", "time"), v.ping).join(masks.drop("time"), ["raw_file", "query_id"])
    lo, hi = J.depth_bins(F.col("min_m") - 2, F.col("max_m") - 2, 0.5, 0.5, 64)
    hit = hit.withColumn("lo", lo).withColumn("hi", hi).filter("lo < hi").join(v.ping.select("raw_file", "ping_idx", "heave_m"), ["raw_file", "ping_idx"])
    cells = hit.select("raw_file", "ping_idx", (F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).alias("bin"), F.rint(F.col("heave_m") / 0.5).cast("int").alias("h"))
    return cells.select("raw_file", "ping_idx", (F.col("bin") - F.col("h")).alias("r")).filter("r between 0 and 63").groupBy("raw_file", "ping_idx", "r").agg(F.count("*").alias("n"))


@query(
    "d9_box_overlap",
    "raw_file:s a:i b:i",
    """SELECT s.raw_file, s.object_id AS a, t.object_id AS b FROM school s JOIN school t ON s.raw_file = t.raw_file AND s.x0 <= t.x1 + 40 AND t.x0 <= s.x1 AND s.y0 <= t.y1 AND t.y0 <= s.y1 WHERE s.x0 <= s.x1 AND t.x0 <= t.x1 + 40""",
)
def box_overlap(v: Survey) -> DataFrame:
    a = v.school.select("raw_file", F.col("object_id").alias("a"), "x0", "x1", "y0", "y1")
    b = v.school.select("raw_file", F.col("object_id").alias("b"), F.col("x0").alias("bx0"), (F.col("x1") + 40).alias("bx1"), F.col("y0").alias("by0"), F.col("y1").alias("by1"))
    return J.box_overlap(a, b, "raw_file", 16)


@query("d10_d17_excluded_files", "raw_file:s n:i", "SELECT raw_file, count(*) AS n FROM ping WHERE survey IN (2008, 2010, 2012) AND raw_file NOT IN ('2024-01-03', '2024-01-17') GROUP BY ALL")
def excluded_files(v: Survey) -> DataFrame:
    bad = v.spark.createDataFrame([("2024-01-03",), ("2024-01-17",)], "raw_file string")
    return v.ping.filter(F.col("survey").isin(2008, 2010, 2012)).join(F.broadcast(bad), "raw_file", "left_anti").groupBy("raw_file").agg(F.count("*").alias("n"))


@query(
    "d11_aligned_channels",
    "raw_file:s freq_hz:i k:i missing:i",
    """SELECT raw_file, f * 1000 AS freq_hz, k, coalesce(m, 64) AS missing FROM (SELECT DISTINCT raw_file, k FROM c) CROSS JOIN freq
       LEFT JOIN (SELECT raw_file, f, k, arg_min(m, ping_idx) AS m FROM c JOIN na USING (raw_file, f, ping_idx) GROUP BY ALL) USING (raw_file, f, k)""",
    """c AS (SELECT raw_file, f, ping_idx, ping_idx + CASE WHEN f = 38 AND ping_idx % 9 = 0 THEN 1 ELSE 0 END AS k FROM ping, freq WHERE NOT (f = 120 AND ping_idx % 11 = 3)),
na AS (SELECT raw_file, f, ping_idx, sum(isnan(v)::INT) AS m FROM sv GROUP BY ALL)""",
)
def aligned_channels(v: Survey) -> DataFrame:
    t = F.col("ping_idx") * 10.0 + F.when((F.col("freq_hz") == 38000) & (F.col("ping_idx") % 9 == 0), 8.0).otherwise(2.0)
    rows = v.sv.filter("not (freq_hz = 120000 and ping_idx % 11 = 3)").select("raw_file", "freq_hz", t.alias("t"), "sv")
    out = J.align_channels(rows, 18000)
    return out.select("raw_file", "freq_hz", "k", F.size(F.filter("sv", lambda x: F.isnan(x))).alias("missing"))


@query(
    "d12_polygons",
    "raw_file:s ping_idx:i r:i category:i",
    """SELECT p.raw_file, p.ping_idx, rng.r, arg_max(category, object_id) AS category FROM school s JOIN ping p ON p.raw_file = s.raw_file, rng WHERE x0 <= x1 AND category <> -1
       AND p.ping_idx BETWEEN x0 AND x1 AND rng.r >= y0 AND rng.r <= y0 + (y1 - y0) * (p.ping_idx - x0) / (x1 - x0)::DOUBLE + 1e-9 GROUP BY ALL""",
)
def polygons(v: Survey) -> DataFrame:
    """Triangles (x0, y0), (x1, y0), (x1, y1) over the schools."""
    tri = v.school.filter("x0 <= x1 and category <> -1").select(
        "raw_file", F.col("object_id").alias("polygon_id"), "category", F.expr("array(double(x0), double(x1), double(x1))").alias("xs"), F.expr("array(double(y0), double(y0), double(y1))").alias("ys")
    )
    return J.cells_in_polygons(tri, v.ping.select("raw_file", "ping_idx"), 64)


@query(
    "d13_interpolated_bottom",
    "raw_file:s query_id:i v:d",
    """SELECT q.raw_file, q.e AS query_id, CASE WHEN a.t = q.ping_time THEN a.v WHEN b.t IS NOT NULL THEN a.v + (epoch_us(q.ping_time) - epoch_us(a.t)) / (epoch_us(b.t) - epoch_us(a.t))::DOUBLE * (b.v - a.v) END AS v
       FROM ping q ASOF LEFT JOIN vals a ON q.raw_file = a.raw_file AND q.ping_time >= a.t ASOF LEFT JOIN vals b ON q.raw_file = b.raw_file AND q.ping_time <= b.t""",
    "vals AS (SELECT raw_file, ping_time AS t, b::DOUBLE AS v FROM ping WHERE e % 10 = 3)",
)
def interpolated_bottom(v: Survey) -> DataFrame:
    values = v.ping.filter("e % 10 = 3").join(v.seabed.drop("survey"), ["raw_file", "ping_idx"]).select("raw_file", F.col("ping_time").alias("t"), F.col("seabed_idx").cast("double").alias("v"))
    return J.interpolated_in_time(v.ping.select("raw_file", F.col("e").alias("query_id"), F.col("ping_time").alias("time")), values)


@query(
    "d14_work_mask_cells",
    "raw_file:s ping_idx:i r:i category:i",
    """SELECT p.raw_file, p.ping_idx, r, 27 AS category FROM ext_mask m JOIN ping p ON p.raw_file = m.raw_file AND p.ping_time = m.time + INTERVAL 30 SECOND, rng WHERE 0.5 * (r + 1) > min_m - 2 AND 0.5 * (r + 1) <= max_m - 2""",
)
def work_mask_cells(v: Survey) -> DataFrame:
    """A mask row names a ping time: it marks every ping of its file at that time."""
    lo, hi = J.depth_bins(F.col("min_m") - 2, F.col("max_m") - 2, 0.5, 0.5, 64)
    masks = v.ext_mask.select((F.col("time") + F.expr("interval 30 seconds")).alias("ping_time"), "raw_file", lo.alias("lo"), hi.alias("hi"), F.lit("m-27").alias("id"))
    hit = masks.filter("lo < hi").join(v.ping, ["raw_file", "ping_time"])
    return hit.select("raw_file", "ping_idx", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("r"), F.element_at(F.split("id", "-"), -1).cast("int").alias("category"))


@query(
    "d15_d16_scattered",
    "raw_file:s ping_idx:i total:d filled:i marked:i",
    """SELECT raw_file, ping_idx, sum(CASE WHEN kept THEN p ELSE 0 END) AS total, sum((kept AND p > 0)::INT) AS filled, sum(CASE WHEN kept THEN label ELSE 0 END) AS marked
       FROM (SELECT *, NOT (ping_idx % 50 = 7 OR label = 0 AND r >= b) AS kept FROM pred JOIN label USING (raw_file, ping_idx, r)) GROUP BY ALL""",
)
def scattered(v: Survey) -> DataFrame:
    """Cells at the seabed and all cells of some pings are ignored; the rest is put back into profiles of every ping."""
    rows = v.pred.join(labelled(v), ["raw_file", "ping_idx"]).join(v.seabed.drop("survey"), ["raw_file", "ping_idx"])
    marks = L.seabed_masked("labels", F.col("seabed_idx"), pad=0)
    marks = F.when(F.col("ping_idx") % 50 == 7, F.array_repeat(F.lit(-100), 64)).otherwise(marks)
    cells = rows.select("raw_file", "ping_idx", F.posexplode(F.arrays_zip("p_sandeel", "p_other", marks.alias("y"))).alias("r", "c"))
    cells = cells.select("raw_file", "ping_idx", "r", F.col("c.y").alias("label"), F.col("c.p_sandeel").alias("p_sandeel"), F.col("c.p_other").alias("p_other"))
    back = J.scatter_predictions(cells, v.ping).withColumn("p", J.dense_profile("cells", "p_sandeel", 64))
    sum_ = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    marked = J.scatter_labels(cells, 64, v.ping).select("raw_file", "ping_idx", sum_("labels").cast("int").alias("marked"))
    return back.select("raw_file", "ping_idx", sum_("p").alias("total"), F.size(F.filter("p", lambda x: x > 0)).alias("filled")).join(marked, ["raw_file", "ping_idx"])


@query("g2_seabed_masked", "raw_file:s code:i n:i", "SELECT raw_file, CASE WHEN label = 0 AND r >= b + 10 THEN -50 ELSE label END AS code, count(*) AS n FROM label GROUP BY ALL")
def seabed_masked(v: Survey) -> DataFrame:
    rows = labelled(v).join(v.seabed.drop("survey"), ["raw_file", "ping_idx"]).select("raw_file", F.explode(L.seabed_masked("labels", F.col("seabed_idx"))).alias("code"))
    return rows.groupBy("raw_file", "code").agg(F.count("*").alias("n"))


@query(
    "g3_overlap_masked",
    "code:i n:i",
    "SELECT CASE WHEN r < 4 OR r >= 60 OR ping_idx % 64 < 4 OR ping_idx % 64 >= 60 THEN -70 ELSE label END AS code, count(*) AS n FROM label GROUP BY ALL",
)
def overlap_masked(v: Survey) -> DataFrame:
    cells = labelled(v).select("ping_idx", F.posexplode("labels").alias("y", "label"))
    return cells.groupBy(L.overlap_masked(F.col("label"), F.col("y"), F.col("ping_idx") % 64, 64, 64, 4).alias("code")).agg(F.count("*").alias("n"))


@query(
    "g4_region_masked",
    "raw_file:s code:i n:i",
    """SELECT raw_file, CASE WHEN hit THEN label ELSE -1 END AS code, count(*) AS n FROM (SELECT l.*, EXISTS (SELECT 1 FROM school s WHERE s.raw_file = l.raw_file AND x0 <= x1 AND category <> -1
       AND l.ping_idx >= x0 - 3 AND l.ping_idx < x1 + 3 AND l.r >= y0 - 3 AND l.r < y1 + 3) AS hit FROM label l) GROUP BY ALL""",
)
def region_masked(v: Survey) -> DataFrame:
    out = L.region_masked(labelled(v), v.school.filter("x0 <= x1 and category <> -1"), 3, compat=True)
    return out.groupBy("raw_file", F.col("label").alias("code")).agg(F.count("*").alias("n"))


@query(
    "g4_trace_masked",
    "raw_file:s code:i n:i",
    """SELECT raw_file, CASE WHEN hit THEN label ELSE -100 END AS code, count(*) AS n FROM (SELECT l.*, EXISTS (SELECT 1 FROM school s WHERE s.raw_file = l.raw_file AND x0 <= x1 AND category <> -1
       AND l.ping_idx >= x0 - 3 AND l.ping_idx < x1 + 3) AS hit FROM label l) GROUP BY ALL""",
)
def trace_masked(v: Survey) -> DataFrame:
    """Whole pings near objects; all other cells are ignored."""
    out = L.region_masked(labelled(v), v.school.filter("x0 <= x1 and category <> -1"), 3, trace=True)
    return out.groupBy("raw_file", F.col("label").alias("code")).agg(F.count("*").alias("n"))


_DISC = "disc AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy * dy + dx * dx <= 10)"


@query(
    "f9_g1_refined_borders",
    "raw_file:s label:i n:i",
    """SELECT raw_file, CASE WHEN label > 0 AND NOT EXISTS (SELECT 1 FROM closed c WHERE c.raw_file = l.raw_file AND c.ping_idx = l.ping_idx AND c.r = l.r) THEN -30 ELSE label END AS label, count(*) AS n FROM lv l GROUP BY ALL""",
    _DISC
    + """, lv AS (SELECT l.raw_file, l.ping_idx, l.r, l.label, s.v FROM label l JOIN sv s ON s.raw_file = l.raw_file AND s.ping_idx = l.ping_idx AND s.r = l.r AND s.f = 200),
seed AS (SELECT raw_file, ping_idx, r FROM lv WHERE label > 0 AND NOT isnan(v) AND v > 1e-7::DOUBLE AND v < 5e-6::DOUBLE),
grown AS (SELECT DISTINCT s.raw_file, s.ping_idx + dx AS ping_idx, s.r + dy AS r FROM seed s, disc JOIN file f ON f.raw_file = s.raw_file WHERE s.ping_idx + dx BETWEEN 0 AND n_pings - 1 AND s.r + dy BETWEEN 0 AND 63),
closed AS (SELECT raw_file, ping_idx + dx AS ping_idx, r + dy AS r FROM grown, disc GROUP BY ALL HAVING count(*) = 37)""",
)
def refined_borders(v: Survey) -> DataFrame:
    rows = labelled(v).join(v.sv.filter("freq_hz = 200000").select("raw_file", "ping_idx", "sv"), ["raw_file", "ping_idx"])
    cells = rows.select("raw_file", "ping_idx", F.posexplode(F.arrays_zip("labels", "sv")).alias("r", "c")).select("raw_file", "ping_idx", "r", F.col("c.labels").alias("label"), F.nanvl("c.sv", F.lit(0.0)).alias("v"))
    # one row for each file: broadcast, so that the cells of a file do not meet it in one task
    box = v.file.select("raw_file", F.lit(0).alias("x0"), (F.col("n_pings") - 1).alias("x1"), F.lit(0).alias("y0"), F.lit(63).alias("y1"))
    return L.refined_borders(cells, F.broadcast(box), ["raw_file"], 1e-7, 5e-6).groupBy("raw_file", "label").agg(F.count("*").alias("n"))
