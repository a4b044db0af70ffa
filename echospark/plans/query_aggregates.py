"""Queries of aggregations, evaluation and regridding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import acoustic as A
from ..operators import evaluation as E
from ..operators import labels as L
from ..operators import objects as O
from ..operators import regrid as R
from ..sources.fixtures import Survey
from . import jobs
from .queries import labelled, query


@query(
    "e1_label_objects",
    "raw_file:s category:i n_pixels:i y0:i y1:i x0:i x1:i segmented:b",
    """SELECT raw_file, label AS category, count(*) AS n_pixels, min(r) AS y0, max(r) AS y1, min(ping_idx) AS x0, max(ping_idx) AS x1,
       (max(r) - min(r) + 1) * (max(ping_idx) - min(ping_idx) + 1) <> count(*) AS segmented FROM (
       SELECT c.raw_file, c.label, c.ping_idx, c.r, min(s.seen) AS comp FROM cl c JOIN reach s ON s.id = c.id GROUP BY ALL) GROUP BY raw_file, label, comp""",
    """cl AS (SELECT raw_file, ping_idx, r, label, e * 64 + r AS id FROM label WHERE label > 0),
nb AS (SELECT a.id AS a, b.id AS b FROM cl a JOIN cl b ON a.raw_file = b.raw_file AND a.label = b.label AND ((a.ping_idx = b.ping_idx AND abs(a.r - b.r) = 1) OR (a.r = b.r AND abs(a.ping_idx - b.ping_idx) = 1))),
reach AS (WITH RECURSIVE w AS (SELECT id, id AS seen FROM cl UNION SELECT w.id, nb.b FROM w JOIN nb ON nb.a = w.seen) SELECT id, min(seen) AS seen FROM w GROUP BY ALL)""",
)
def label_objects(v: Survey) -> DataFrame:
    return O.label_objects(labelled(v)).withColumnRenamed("labeled_as_segmentation", "segmented")


@query(
    "e3_e18_e22_summaries",
    "survey:i raw_files:i pings:i cells:i first:s last:s freqs:i",
    """SELECT survey, count(DISTINCT raw_file) AS raw_files, count(*) AS pings, count(*) * 64 AS cells, strftime(min(ping_time), '%Y-%m-%d') AS first, strftime(max(ping_time), '%Y-%m-%d') AS last, (SELECT count(DISTINCT f) FROM sv WHERE sv.raw_file IN (SELECT raw_file FROM ping q WHERE q.survey = ping.survey)) AS freqs FROM ping GROUP BY survey""",
)
def summaries(v: Survey) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    files = v.ping.groupBy("survey", "raw_file").agg(F.count("*").alias("n"), F.min("ping_time").alias("a"), F.max("ping_time").alias("b"))
    totals = files.groupBy("survey").agg(F.count("*").alias("raw_files"), F.sum("n").alias("pings"), F.sum(F.col("n") * 64).alias("cells"), day(F.min("a")).alias("first"), day(F.max("b")).alias("last"))
    freqs = v.sv.select("survey", "freq_hz").distinct().groupBy("survey").agg(F.count("*").alias("freqs"))
    return totals.join(freqs, "survey")


@query("e14_dominant_species", "object_id:i species:i", "SELECT e AS object_id, arg_min(s, (-((e * 7 + s * 13) % 5), s)) AS species FROM ping, (SELECT unnest([1, 27, 6009]) AS s) WHERE e % 25 = 0 GROUP BY ALL")
def dominant_species(v: Survey) -> DataFrame:
    rows = v.school.select("object_id", F.explode(F.array(*map(F.lit, (1, 27, 6009)))).alias("species"))
    rows = rows.withColumn("fraction", (F.col("object_id") * 7 + F.col("species") * 13) % 5).withColumn("rank", F.col("species")).withColumn("channel", F.lit(0))
    return O.dominant_species(rows)


@query(
    "e21_objects_by_species",
    "raw_file:s category:i objects:s",
    """SELECT raw_file, category, string_agg(object_id || ':' || y0 || ':' || y1 || ':' || x0 || ':' || x1, ',' ORDER BY object_id) AS objects FROM school WHERE x0 <= x1 AND category <> -1 GROUP BY ALL""",
)
def objects_by_species(v: Survey) -> DataFrame:
    rows = O.objects_by_species(v.school.filter("x0 <= x1 and category <> -1"))
    text = F.transform("objects", lambda o: F.concat_ws(":", o["object_id"], o["box"]["y0"], o["box"]["y1"], o["box"]["x0"], o["box"]["x1"]))
    return rows.select("raw_file", "category", F.array_join(text, ",").alias("objects"))


SCORED = """cells AS (SELECT survey, p AS score, label = 27 AS positive FROM pred JOIN label USING (raw_file, ping_idx, r)),
cnt AS (SELECT survey, score, sum(positive::INT) AS p, count(*) AS n FROM cells GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER (PARTITION BY survey ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY survey ORDER BY score DESC) AS seen, sum(p) OVER (PARTITION BY survey) AS total FROM cnt),
curve AS (SELECT survey, score AS threshold, tp / seen AS precision, tp / nullif(total, 0) AS recall FROM cum WHERE score >= (SELECT max(score) FROM cum c WHERE c.survey = cum.survey AND c.tp = c.total)
  UNION ALL SELECT DISTINCT survey, NULL, 1, 0 FROM cnt),
pr AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM curve)"""


def scored(v: Survey) -> DataFrame:
    rows = v.pred.join(labelled(v), ["raw_file", "ping_idx"]).select("survey", F.explode(F.arrays_zip("p_sandeel", "labels")).alias("c"))
    return rows.select("survey", F.col("c.p_sandeel").alias("score"), (F.col("c.labels") == 27).alias("positive"))


@query("e4_f8_precision_recall", "survey:i threshold:d precision:d recall:d f1:d", "SELECT survey, threshold, precision, recall, f1 FROM pr", SCORED)
def precision_recall(v: Survey) -> DataFrame:
    return E.precision_recall(scored(v), ["survey"])


@query("e5_m5_best_f1", "survey:i f1:d threshold:d", "SELECT survey, max(f1) AS f1, arg_min(threshold, (-round(f1, 12), threshold)) AS threshold FROM pr WHERE threshold IS NOT NULL GROUP BY ALL", SCORED)
def best_f1(v: Survey) -> DataFrame:
    curve = E.precision_recall(scored(v), ["survey"]).withColumn("f1", F.round("f1", 12))
    return E.best_f1(curve, ["survey"])


VALID = """chain AS (SELECT survey, r, pred.ping_idx AS k, p, CASE WHEN label <> 0 THEN CASE label WHEN 27 THEN 1 WHEN 1 THEN 2 ELSE -10 END WHEN r >= b + 10 THEN -50 WHEN r % 32 < 2 THEN -70 ELSE 0 END AS y
  FROM pred JOIN label USING (raw_file, ping_idx, r)),
each AS (SELECT survey, m, CASE WHEN y = -50 THEN 0 WHEN m = 0 THEN p ELSE (p + m * (y = 1)::INT * 0.25::DOUBLE) / (1 + m * 0.25::DOUBLE) END AS score, y = 1 AS positive FROM chain, (SELECT unnest([0, 1, 2]) AS m) WHERE y NOT IN (-70, -10)),
cnt AS (SELECT survey, m, score, sum(positive::INT) AS p, count(*) AS n FROM each GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY survey, m) AS total FROM cnt WINDOW w AS (PARTITION BY survey, m ORDER BY score DESC)),
pr AS (SELECT survey, m, score AS threshold, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (seen + total) ELSE 0 END, 12) AS f1 FROM cum WHERE score >= coalesce((SELECT max(score) FROM cum c WHERE c.survey = cum.survey AND c.m = cum.m AND c.tp = c.total), 0)),
best AS (SELECT survey, m, max(f1) AS f1, arg_min(threshold, (-f1, threshold)) AS threshold FROM pr GROUP BY ALL)"""


def valid_scores(v: Survey) -> DataFrame:
    """survey, m, score, positive of the cells that count, under the test chain, for three models of rising skill."""
    rows = v.pred.join(labelled(v), ["raw_file", "ping_idx"]).join(v.seabed.drop("survey"), ["raw_file", "ping_idx"])
    marks = L.seabed_masked(F.transform("labels", A.species_class_other), F.col("seabed_idx"))
    marks = F.transform(marks, lambda y, r: F.when((y == 0) & (r % 32 < 2), A.OVERLAP).otherwise(y))
    cells = rows.select("survey", F.explode(F.arrays_zip("p_sandeel", marks.alias("y"))).alias("c")).select("survey", F.col("c.p_sandeel").alias("score"), F.col("c.y").alias("label"))
    m, gain = F.col("m"), F.col("m") * 0.25
    skilled = F.when(m == 0, F.col("score")).otherwise((F.col("score") + gain * (F.col("label") == 1).cast("int")) / (1 + gain))
    cells = cells.withColumn("m", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("score", skilled)
    return E.valid_cells(cells).select("survey", "m", "score", (F.col("label") == 1).alias("positive"))


@query("c19_m5_survey_evaluation", "survey:i m:i f1:d threshold:d", "SELECT * FROM best", VALID)
def survey_evaluation(v: Survey) -> DataFrame:
    """Label chain, scores 0 below the seabed, ignored cells out, curves and their best F1, for all surveys and models at once."""
    curve = E.precision_recall(valid_scores(v), ["survey", "m"]).withColumn("f1", F.round("f1", 12))
    return E.best_f1(curve, ["survey", "m"]).select("survey", "m", "f1", "threshold")


@query("m4_best_model", "model:i f1:d threshold:d", "SELECT m AS model, f1, threshold FROM best WHERE survey = 2010 ORDER BY f1 DESC, m LIMIT 1", VALID)
def best_model(v: Survey) -> DataFrame:
    """The model with the best F1 on the validation survey."""
    curve = E.precision_recall(valid_scores(v).filter("survey = 2010"), ["m"]).withColumn("f1", F.round("f1", 12)).withColumnRenamed("m", "model")
    return jobs.best_model(curve).select("model", "f1", "threshold")


@query(
    "e6_weighted_loss",
    "loss:d",
    """SELECT avg(loss) AS loss FROM (SELECT e % 16 AS batch, sum(w * -ln(q)) / sum(w) AS loss FROM (
       SELECT ping.e, CASE label WHEN 0 THEN 10 WHEN 27 THEN 300 ELSE 250 END AS w, CASE label WHEN 27 THEN (p + 0.01) / 1.03 ELSE ((1 - p) / 2 + 0.01) / 1.03 END AS q
       FROM label JOIN pred USING (raw_file, ping_idx, r) JOIN ping USING (raw_file, ping_idx) WHERE label <> 6009) GROUP BY ALL)""",
)
def weighted_loss(v: Survey) -> DataFrame:
    rows = v.pred.join(labelled(v), ["raw_file", "ping_idx"]).join(v.ping.select("raw_file", "ping_idx", "e"), ["raw_file", "ping_idx"])
    cells = rows.select((F.col("e") % 16).alias("batch"), F.explode(F.arrays_zip("p_sandeel", "p_other", "labels")).alias("c"))
    q = lambda c: (c + 0.01) / 1.03
    return E.weighted_loss(cells.select("batch", A.species_class(F.col("c.labels")).alias("label"), q(F.col("c.p_other")).alias("p0"), q(F.col("c.p_sandeel")).alias("p1"), q(F.col("c.p_other")).alias("p2")))


_IOU = """fd AS (SELECT s.raw_file, s.category, object_id * 2 + k AS det_id, x0 + 1 + k AS bx0, x1 + 2 - k AS bx1, y0 AS by0, y1 + 1 - k AS by1, ((object_id * 7 + k * 3) % 100) / 100.0::DOUBLE AS score
  FROM school s, (SELECT unnest([0, 1]) AS k) WHERE x0 <= x1 AND category <> -1),
pr AS (SELECT d.raw_file, d.det_id, t.object_id, d.score, (least(t.x1, d.bx1) - greatest(t.x0, d.bx0) + 1) * (least(t.y1, d.by1) - greatest(t.y0, d.by0) + 1) AS i,
  (t.x1 - t.x0 + 1) * (t.y1 - t.y0 + 1) + (d.bx1 - d.bx0 + 1) * (d.by1 - d.by0 + 1) AS a FROM school t JOIN fd d ON t.raw_file = d.raw_file AND t.category = d.category AND t.x0 <= d.bx1 AND d.bx0 <= t.x1 AND t.y0 <= d.by1 AND d.by0 <= t.y1
  WHERE t.x0 <= t.x1 AND bx0 <= bx1 AND by0 <= by1),
iou AS (SELECT raw_file, det_id, object_id, score, i / (a - i)::DOUBLE AS iou FROM pr),
need AS (SELECT *, dense_rank() OVER (PARTITION BY raw_file ORDER BY score DESC, det_id) AS turn FROM iou WHERE iou >= 0.3),
-- detections are served in turn: each takes the best truth that no earlier one has
served AS (SELECT raw_file, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS det_id, NULL::DOUBLE AS iou FROM (SELECT DISTINCT raw_file FROM need)
  UNION ALL SELECT s.raw_file, s.turn + 1, CASE WHEN b.object_id IS NULL THEN s.taken ELSE list_append(s.taken, b.object_id) END, b.det_id, b.iou
  FROM served s JOIN (SELECT raw_file, max(turn) AS last FROM need GROUP BY ALL) l USING (raw_file)
  LEFT JOIN LATERAL (SELECT arg_max(n.object_id, (n.iou, -n.object_id)) AS object_id, max(n.iou) AS iou, min(n.det_id) AS det_id FROM need n
    WHERE n.raw_file = s.raw_file AND n.turn = s.turn + 1 AND NOT list_contains(s.taken, n.object_id)) b ON true WHERE s.turn < l.last)"""


@query("e19_box_matches", "det_id:i iou:d hit:b", "SELECT fd.det_id, s.iou, s.iou IS NOT NULL AS hit FROM fd LEFT JOIN (SELECT det_id, iou FROM served WHERE iou IS NOT NULL) s ON s.det_id = fd.det_id", _IOU, recursive=True)
def box_matches(v: Survey) -> DataFrame:
    """Two detections of each school, so that equal and second-best truths are asked for."""
    return E.match_boxes(*_boxes(v), 16, 0.3).withColumnRenamed("is_match", "hit")


def _boxes(v: Survey) -> tuple[DataFrame, DataFrame]:
    truth = v.school.filter("x0 <= x1 and category <> -1")
    k = F.col("k")
    found = truth.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "raw_file",
        "category",
        (F.col("object_id") * 2 + k).alias("det_id"),
        (F.col("x0") + 1 + k).alias("bx0"),
        (F.col("x1") + 2 - k).alias("bx1"),
        F.col("y0").alias("by0"),
        (F.col("y1") + 1 - k).alias("by1"),
        ((F.col("object_id") * 7 + k * 3) % 100 / 100.0).alias("score"),
    )
    return truth, found


_AREAS = {"all": (0, 10_000_000), "small": (0, 40), "large": (41, 10_000_000)}
_AP = (
    _IOU[: _IOU.index("pr AS (")]
    + """best AS (SELECT *, (bx1 - bx0 + 1) * (by1 - by0 + 1) AS fa FROM fd QUALIFY row_number() OVER (PARTITION BY raw_file, category ORDER BY score DESC, det_id) <= 100),
tr AS (SELECT *, (x1 - x0 + 1) * (y1 - y0 + 1) AS ta FROM school WHERE x0 <= x1 AND category <> -1),
ar AS (SELECT unnest(['all', 'small', 'large']) AS area, unnest([0, 0, 41]) AS lo, unnest([10000000, 40, 10000000]) AS hi), th AS (SELECT unnest([0.5, 0.75])::DOUBLE AS thr),
ov AS (SELECT d.raw_file, d.category, d.det_id, t.object_id, d.score, fa, ta, greatest(least(t.x1, d.bx1) - greatest(t.x0, d.bx0) + 1, 0) * greatest(least(t.y1, d.by1) - greatest(t.y0, d.by0) + 1, 0) AS i
  FROM tr t JOIN best d ON t.raw_file = d.raw_file AND t.category = d.category WHERE bx0 <= bx1),
need AS (SELECT *, i / (fa + ta - i)::DOUBLE AS iou, (ta < lo OR ta > hi) AS ig, dense_rank() OVER (PARTITION BY raw_file, category, area, thr ORDER BY score DESC, det_id) AS turn FROM ov, ar, th WHERE i / (fa + ta - i)::DOUBLE >= thr),
served AS (SELECT raw_file, category, area, thr, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS det_id, NULL::BOOLEAN AS ig FROM (SELECT DISTINCT raw_file, category, area, thr FROM need)
  UNION ALL SELECT s.raw_file, s.category, s.area, s.thr, s.turn + 1, CASE WHEN b.object_id IS NULL THEN s.taken ELSE list_append(s.taken, b.object_id) END, b.det_id, b.ig
  FROM served s JOIN (SELECT raw_file, category, area, thr, max(turn) AS last FROM need GROUP BY ALL) l USING (raw_file, category, area, thr)
  LEFT JOIN LATERAL (SELECT arg_min(n.object_id, (n.ig::INT, -n.iou, n.object_id)) AS object_id, min(n.det_id) AS det_id, arg_min(n.ig, (n.ig::INT, -n.iou, n.object_id)) AS ig FROM need n
    WHERE n.raw_file = s.raw_file AND n.category = s.category AND n.area = s.area AND n.thr = s.thr AND n.turn = s.turn + 1 AND NOT list_contains(s.taken, n.object_id)) b ON true WHERE s.turn < l.last),
cnt AS (SELECT category, area, count(*) AS n FROM tr, ar WHERE ta BETWEEN lo AND hi GROUP BY ALL),
jd AS (SELECT b.category, area, thr, b.det_id, b.score, (s.det_id IS NOT NULL)::INT AS hit FROM best b CROSS JOIN ar CROSS JOIN th LEFT JOIN (SELECT * FROM served WHERE det_id IS NOT NULL) s USING (det_id, area, thr) WHERE NOT coalesce(s.ig, fa < lo OR fa > hi)),
cv AS (SELECT category, area, thr, sum(hit) OVER w AS tp, row_number() OVER w AS seen FROM jd WINDOW w AS (PARTITION BY category, area, thr ORDER BY score DESC, det_id)),
env AS (SELECT c.category, c.area, th.thr, k, max(tp / seen) AS best FROM cnt c CROSS JOIN th CROSS JOIN (SELECT unnest(range(101)) AS k) LEFT JOIN cv ON cv.category = c.category AND cv.area = c.area AND cv.thr = th.thr AND 100 * tp >= k * n GROUP BY ALL)"""
)


@query("e19_average_precision", "category:i area:s threshold:d n:i ap:d", "SELECT category, area, thr AS threshold, n, avg(coalesce(best, 0)) AS ap FROM env JOIN cnt USING (category, area) GROUP BY ALL", _AP, recursive=True)
def average_precision(v: Survey) -> DataFrame:
    """Average precision by category, area range and least overlap."""
    truth, found = _boxes(v)
    return E.average_precision(truth, found, 16, (0.5, 0.75), _AREAS)


_BOUNDS = """tb AS (SELECT raw_file, ping_idx, t - coalesce((t - lag(t) OVER w) / 2, (lead(t) OVER w - t) / 2, 0.5) AS t0, t + coalesce((lead(t) OVER w - t) / 2, (t - lag(t) OVER w) / 2, 0.5) AS t1
  FROM (SELECT raw_file, ping_idx, (epoch_us(ping_time) - min(epoch_us(ping_time)) OVER (PARTITION BY raw_file)) / 1e6::DOUBLE AS t FROM ping) WINDOW w AS (PARTITION BY raw_file ORDER BY ping_idx))"""


@query(
    "e15_regridded_pings",
    "raw_file:s freq_hz:i bin:i r:i db:d",
    """SELECT raw_file, f * 1000 AS freq_hz, bin, r, 10 * log10(sum(v * w) / sum(w)) AS db FROM sv JOIN (SELECT raw_file, ping_idx, bin, least(t1, (bin + 1) * 1800) - greatest(t0, bin * 1800) AS w
       FROM (SELECT *, unnest(range(floor(t0 / 1800)::BIGINT, floor(t1 / 1800)::BIGINT + 1)) AS bin FROM tb)) USING (raw_file, ping_idx) WHERE w > 0 AND NOT isnan(v) GROUP BY ALL""",
    _BOUNDS,
)
def regridded_pings(v: Survey) -> DataFrame:
    rows = v.sv.select("raw_file", "ping_idx", "freq_hz", "sv")
    return R.regrid_pings(rows, R.ping_bounds(v.ping), 1800.0).filter(~F.isnan("v")).select("raw_file", "freq_hz", "bin", "r", (10 * F.log10("v")).alias("db"))


@query(
    "e15_regridded_range",
    "raw_file:s freq_hz:i bin:i total:d",
    """SELECT raw_file, f * 1000 AS freq_hz, bin, sum(x) AS total FROM (SELECT raw_file, f, ping_idx, bin, sum(v * 1e6 * w) / sum(w) AS x FROM (SELECT s.*, bin, least((bin + 1) * 0.75, (r + 1) * 0.5) - greatest(bin * 0.75, r * 0.5) AS w
       FROM sv s JOIN (SELECT unnest(range(43)) AS bin) ON bin BETWEEN r * 2 // 3 - 1 AND r * 2 // 3 + 1 WHERE NOT isnan(v)) WHERE w > 0 GROUP BY ALL) GROUP BY ALL""",
)
def regridded_range(v: Survey) -> DataFrame:
    rows = v.sv.select("raw_file", "freq_hz", R.regrid_range("sv", 0.25, 0.5, 64, 0.75, 43).alias("x")).select("raw_file", "freq_hz", F.posexplode("x").alias("bin", "x")).filter(~F.isnan("x"))
    return rows.groupBy("raw_file", "freq_hz", "bin").agg(F.sum(F.col("x") * 1e6).alias("total"))


@query(
    "e7_energy_kept",
    "raw_file:s freq_hz:i kept:b",
    """SELECT raw_file, f * 1000 AS freq_hz, abs(sum(n) - sum(o)) <= sum(o) / 5000 AS kept FROM (SELECT *, CASE WHEN isnan(v) THEN 0 ELSE v END AS o, CASE WHEN isnan(v) THEN 0 WHEN r = 20 AND f = 38 THEN v * 1.2 ELSE v END AS n FROM sv) GROUP BY ALL""",
)
def energy_kept(v: Survey) -> DataFrame:
    louder = F.concat(F.slice("sv", 1, 20), F.array(F.get("sv", F.lit(20)) * 1.2), F.slice("sv", F.lit(22), F.size("sv") - 21))
    changed = v.sv.withColumn("sv", F.when(F.col("freq_hz") == 38000, louder).otherwise(F.col("sv")))
    return R.energy_kept(v.sv, changed, ["raw_file", "freq_hz"])


@query(
    "e8_e9_file_checks",
    "raw_file:s rate_ok:b steady:b",
    """SELECT raw_file, coalesce(bool_and(abs(1 / d - 0.004) <= 0.05), true) AS rate_ok, max(td) = min(td) AS steady FROM (SELECT raw_file, CASE WHEN raw_file = '2024-01-05' AND ping_idx = 7 THEN 6 ELSE 5 END AS td,
       (epoch_us(ping_time) - lag(epoch_us(ping_time)) OVER (PARTITION BY raw_file ORDER BY ping_idx)) / 1e6::DOUBLE AS d FROM ping) GROUP BY ALL""",
)
def file_checks(v: Survey) -> DataFrame:
    rows = v.ping.withColumn("transducer_depth_m", F.when((F.col("raw_file") == "2024-01-05") & (F.col("ping_idx") == 7), 6.0).otherwise(F.col("transducer_depth_m")))
    unsteady = R.unsteady_depth(rows).withColumn("u", F.lit(True))
    return R.ping_rate_ok(rows, 0.004).join(unsteady, "raw_file", "left").select("raw_file", "rate_ok", F.col("u").isNull().alias("steady"))


@query("e10_range_limit", "survey:i max_range:d", "SELECT survey, quantile_cont(0.5::DOUBLE * (b + 1), 0.95) + 15 AS max_range FROM ping GROUP BY ALL")
def range_limit(v: Survey) -> DataFrame:
    return R.range_limit(v.seabed.select("survey", (0.5 * (F.col("seabed_idx") + 1)).alias("depth")), ["survey"])


@query(
    "e11_e12_resampled_range",
    "raw_file:s j:i mean:d line:d",
    """SELECT raw_file, j, sum(mean) AS mean, sum(line) AS line FROM (SELECT raw_file, ping_idx, j, avg(x) FILTER (r // 4 = j) AS mean, sum(CASE WHEN r = j * 3 // 2 THEN x * (1 - (j * 1.5 - j * 3 // 2)) WHEN r = j * 3 // 2 + 1 THEN x * (j * 1.5 - j * 3 // 2) ELSE 0 END) AS line
       FROM (SELECT raw_file, ping_idx, r, ((e * 17 + r * 29) % 1000) / 1000.0::DOUBLE AS x FROM ping, rng), (SELECT unnest(range(16)) AS j) GROUP BY ALL) GROUP BY ALL""",
)
def resampled_range(v: Survey) -> DataFrame:
    rows = v.pred.select("raw_file", R.bin_means("p_sandeel", 0.5, 0.5, 0.25, 2.0, 16).alias("m"), R.interpolated_range("p_sandeel", 0.5, 0.5, 0.5, 0.75, 16).alias("l"))
    rows = rows.select("raw_file", F.posexplode(F.arrays_zip("m", "l")).alias("j", "c"))
    return rows.groupBy("raw_file", "j").agg(F.sum("c.m").alias("mean"), F.sum("c.l").alias("line"))


@query(
    "e13_e20_range_choice",
    "raw_file:s dr:d choice:s",
    """SELECT raw_file, dr, CASE WHEN dr < 0.45 THEN 'average' WHEN dr > 0.55 THEN 'interpolate' ELSE 'keep' END AS choice FROM (SELECT raw_file, (2 + n_pings % 3) / 6.0::DOUBLE AS dr FROM file)""",
)
def range_choice(v: Survey) -> DataFrame:
    ranges = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda r: r * ((2 + F.col("n_pings") % 3) / 6.0))
    return R.range_choice(v.file.select("raw_file", ranges.alias("range_m")), 0.5)


@query(
    "e16_nearest_regrid",
    "raw_file:s ping_idx:i label:i n:i",
    """SELECT l.raw_file, q.ping_idx, label, count(*) AS n FROM (SELECT raw_file, ping_idx, ping_idx // 4 * 4 + CASE WHEN ping_idx % 4 = 3 AND ping_idx // 4 * 4 + 4 < n_pings THEN 4 ELSE 0 END AS src FROM ping JOIN file USING (raw_file)) q
       JOIN label l ON l.raw_file = q.raw_file AND l.ping_idx = q.src WHERE label > 0 GROUP BY ALL""",
)
def nearest_regrid(v: Survey) -> DataFrame:
    """Labels known at every fourth ping, put back on all pings by the nearest one."""
    from ..operators.joins import nearest_in_time

    at = lambda c: F.timestamp_seconds(F.col(c) * 10).cast("timestamp_ntz")
    known = v.ping.filter("ping_idx % 4 = 0").select("raw_file", "ping_idx", at("ping_idx").alias("ping_time"))
    asked = v.ping.select("raw_file", F.col("ping_idx").alias("query_id"), at("ping_idx").alias("time"))
    hit = nearest_in_time(asked, known).join(labelled(v), ["raw_file", "ping_idx"])
    return hit.select("raw_file", F.col("query_id").alias("ping_idx"), F.explode("labels").alias("label")).filter("label > 0").groupBy("raw_file", "ping_idx", "label").agg(F.count("*").alias("n"))


@query(
    "e17_tile_counts",
    "raw_file:s ty:i tx:i n:i",
    """SELECT raw_file, ty, tx, count(*) AS n FROM (SELECT *, unnest(range(greatest((ping_idx - 8) // 24, 0), ping_idx // 24 + 1)) AS tx FROM label WHERE label <> 0), (SELECT unnest(range(8)) AS ty) WHERE r >= ty * 12 AND r < ty * 12 + 16 AND ping_idx >= tx * 24 AND ping_idx < tx * 24 + 32 GROUP BY ALL""",
)
def tile_counts(v: Survey) -> DataFrame:
    return R.tile_counts(labelled(v), 16, 32, 12, 24)
