"""Queries of sampling, sources, chains and jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import acoustic as A
from ..operators import joins as J
from ..operators import labels as L
from ..operators import sampling as P
from ..operators import slices as S
from ..operators.evaluation import best_f1, counted_curve, half_precision_profile, masked_counts, precision_recall
from ..operators.objects import written
from ..operators.seabed import seabed_line
from ..sources import tables as T
from ..sources.fixtures import FREQ_KHZ, Survey
from ..sources.matrices import ingest, write_matrices
from ..streaming.incremental import run_new_files
from . import jobs
from .patches import META, Recipe, patch_columns, patch_labels, patch_set, store_patches
from .prediction import committed, predict_new_files, predicted
from .queries import labelled, query
from .query_aggregates import SCORED, scored
from .query_functions import LINE, STENCIL, whole_profiles

_U = A.keyed_uniform_sql
_OBJ = "obj AS (SELECT s.*, (p.b - y1)::DOUBLE AS d FROM school s LEFT JOIN ping p ON p.raw_file = s.raw_file AND p.ping_idx = x0 + trunc((x1 - x0) / 2.0)::INT WHERE x0 <= x1 AND category <> -1)"


def _scratch(v: Survey, name: str) -> str:
    root = v.spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        written(v.spark.range(1))
        root = v.spark.conf.get("spark.checkpoint.dir")
    return f"{root}/{name}-{uuid.uuid4().hex}"


@query(
    "h1_mixture_draws",
    "sampler:s n:i",
    f"""SELECT CASE WHEN u < 1 / 26.0 THEN 'background' WHEN u < 6 / 26.0 THEN 'seabed' WHEN u < 11 / 26.0 THEN 'school_27' WHEN u < 16 / 26.0 THEN 'school_1' WHEN u < 21 / 26.0 THEN 'school_seabed_27' ELSE 'school_seabed_1' END AS sampler,
        count(*) AS n FROM (SELECT {_U("e", 11)} AS u FROM ping) GROUP BY ALL""",
)
def mixture(v: Survey) -> DataFrame:
    return P.mixture_draws(v.ping.select(F.col("e").alias("draw_id")), 11).groupBy("sampler").agg(F.count("*").alias("n"))


def _pings(v: Survey) -> DataFrame:
    return v.ping.select("raw_file", "ping_idx", F.col("e").alias("key")).join(v.seabed.drop("survey"), ["raw_file", "ping_idx"])


_CLEAR = "NOT EXISTS (SELECT 1 FROM school s WHERE s.raw_file = c.raw_file AND x0 <= x1 AND category <> -1 AND cx >= x0 - 16 AND cx <= x1 + 16 AND cy >= y0 - 16 AND cy <= y1 + 16)"


def _drawn_sql(seed: int, draws: str, size: int) -> str:
    """drawn: a centre for each draw_id of `draws`, from the pools of all samplers with windows of size x size cells."""
    u = [_U("draw_id", seed + i) for i in range(6)]
    h = size // 2
    kinds = "SELECT 'school_' || category AS sampler, * FROM obj UNION ALL SELECT 'school_seabed_' || category, * FROM obj WHERE d < " + str(h)
    clear = f"NOT EXISTS (SELECT 1 FROM school s WHERE s.raw_file = c.raw_file AND x0 <= x1 AND category <> -1 AND cx >= x0 - {h} AND cx <= x1 + {h} AND cy >= y0 - {h} AND cy <= y1 + {h})"
    return f"""{_OBJ}, pool AS (
  SELECT 'background' AS sampler, raw_file, e AS key, cx AS x0, 1 AS w, cy AS y0, 1 AS h, 0 AS jx, 0 AS jy FROM (SELECT raw_file, e, floor({_U('e', 21)} * (b - {h})) AS cy, ping_idx AS cx FROM ping WHERE b > {h}) c WHERE {clear}
  UNION ALL SELECT 'seabed', raw_file, e, ping_idx, 1, b, 1, 0, {size} FROM ping
  UNION ALL SELECT sampler, raw_file, object_id, x0, greatest(x1 - x0, 1), y0, greatest(y1 - y0, 1), {size}, {size} FROM ({kinds}) WHERE category IN (27, 1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY sampler ORDER BY raw_file, key) - 1 AS rank, count(*) OVER (PARTITION BY sampler) AS n FROM pool),
told AS (SELECT draw_id, CASE WHEN u < 1 / 26.0 THEN 'background' WHEN u < 6 / 26.0 THEN 'seabed' WHEN u < 11 / 26.0 THEN 'school_27' WHEN u < 16 / 26.0 THEN 'school_1' WHEN u < 21 / 26.0 THEN 'school_seabed_27' ELSE 'school_seabed_1' END AS sampler
  FROM (SELECT draw_id, {u[0]} AS u FROM {draws})),
drawn AS (SELECT draw_id, sampler, raw_file, key, y0 + floor({u[4]} * h)::BIGINT + floor({u[5]} * (jy + 1))::BIGINT - jy // 2 AS cy, x0 + floor({u[2]} * w)::BIGINT + floor({u[3]} * (jx + 1))::BIGINT - jx // 2 AS cx
  FROM told JOIN placed USING (sampler) WHERE rank = floor({u[1]} * n))"""


def _draws(v: Survey, seed: int, size: int, draws: DataFrame) -> DataFrame:
    pool = P.pools(_pings(v), J.objects_with_seabed(v.school, v.seabed), v.school.filter("x0 <= x1 and category <> -1"), 21, size, size)
    return P.drawn_centres(draws, pool, seed)


@query("h1_drawn_centres", "draw_id:i sampler:s raw_file:s key:i cy:i cx:i", "SELECT * FROM drawn", _drawn_sql(11, "(SELECT e AS draw_id FROM ping)", 32))
def drawn_centres(v: Survey) -> DataFrame:
    """As many draws as pings, each with a centre from the pool of its sampler."""
    return _draws(v, 11, 32, v.ping.select(F.col("e").alias("draw_id")))


@query("h2_background", "raw_file:s cy:i cx:i", f"SELECT raw_file, cy, cx FROM (SELECT raw_file, floor({_U('e', 21)} * (b - 16)) AS cy, ping_idx AS cx FROM ping WHERE b > 16) c WHERE {_CLEAR}")
def background(v: Survey) -> DataFrame:
    return P.without_labels(P.background_centres(_pings(v), 21, 32), v.school.filter("x0 <= x1 and category <> -1"), 32, 32)


@query("h3_h4_seabed", "raw_file:s cy:i cx:i clear:b", f"SELECT raw_file, cy, cx, {_CLEAR} AS clear FROM (SELECT raw_file, b + floor({_U('e', 31)} * 33) - 16 AS cy, ping_idx AS cx FROM ping WHERE b > 0) c")
def seabed_sampler(v: Survey) -> DataFrame:
    centres = P.seabed_centres(_pings(v), 31, 32)
    clear = P.without_labels(centres, v.school.filter("x0 <= x1 and category <> -1"), 32, 32).withColumn("c", F.lit(True))
    return centres.join(clear, ["raw_file", "cy", "cx"], "left").withColumn("clear", F.coalesce("c", F.lit(False)))


_CENTRE = f"""floor(y0 + {_U("object_id", 41)} * greatest(y1 - y0, 1)) + floor({_U("object_id", 43)} * 33) - 16 AS cy,
  floor(x0 + {_U("object_id", 42)} * greatest(x1 - x0, 1)) + floor({_U("object_id", 44)} * 33) - 16 AS cx"""


@query("h5_h6_schools", "object_id:i cy:i cx:i near:b", f"SELECT object_id, {_CENTRE}, coalesce(d < 16, false) AS near FROM obj", _OBJ)
def school_sampler(v: Survey) -> DataFrame:
    objects = J.objects_with_seabed(v.school, v.seabed)
    near = P.school_centres(objects, 41, 32, 32, 16.0).select("object_id", F.lit(True).alias("n"))
    return P.school_centres(objects, 41, 32, 32).join(near, "object_id", "left").withColumn("near", F.coalesce("n", F.lit(False)))


@query(
    "h7_windows",
    "object_id:i centre:i",
    f"""SELECT object_id, floor(least(lo, hi) + u * greatest(hi - lo, 0)) AS centre FROM (SELECT object_id, greatest(11, y0 - 11) AS lo, least(64 - 11, y0 + 11) AS hi, {_U("object_id", 51)} AS u FROM school)""",
)
def windows(v: Survey) -> DataFrame:
    return v.school.select("object_id", P.window_with_point(F.col("y0"), 64, 32, A.keyed_uniform(F.col("object_id"), 51), slack=5).alias("centre"))


@query(
    "h8_h10_splits",
    "raw_file:s split:s evaluated:b trained:b",
    f"""SELECT raw_file, CASE WHEN (row_number() OVER (ORDER BY u, id) - 1) / (count(*) OVER () - 1)::DOUBLE < 0.85 THEN 'train' ELSE 'test' END AS split, survey NOT IN (2012) AS evaluated, survey <= 2012 AS trained
        FROM (SELECT *, {_U("id", 61)} AS u FROM (SELECT survey, raw_file, replace(raw_file, '-', '')::BIGINT AS id FROM file))""",
)
def splits(v: Survey) -> DataFrame:
    files = v.file.withColumn("file_id", F.replace("raw_file", F.lit("-"), F.lit("")).cast("bigint"))
    out = P.train_test_split(files, 61)
    years = P.split_by_years(files, range(2007, 2013), [2017]).filter("split = 'train'").select("raw_file", F.lit(True).alias("t"))
    out = out.join(years, "raw_file", "left")
    return out.select("raw_file", "split", F.col("survey").isin(*P.EVALUATION_YEARS).alias("evaluated"), F.coalesce("t", F.lit(False)).alias("trained"))


@query("h_first_by_hash", "category:i object_id:i", f"SELECT category, object_id FROM school QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_U('object_id', 71)}, object_id) <= 10")
def first_by_hash(v: Survey) -> DataFrame:
    return P.first_by_hash(v.school, ["category"], F.col("object_id"), 71, 10)


@query("a3_usable_files", "survey:i raw_file:s", "SELECT survey, raw_file FROM file WHERE n_pings > 300 AND n_pings % 7 <> 0 AND n_pings % 5 <> 0 AND survey <= 2015 AND raw_file <> '2024-01-03'")
def usable_files(v: Survey) -> DataFrame:
    n = F.col("n_pings")
    files = v.file.withColumn("freqs", F.array(*map(F.lit, FREQ_KHZ))).withColumn("n_times", n - (n % 7 == 0).cast("int")).withColumn("n_heave", n + (n % 5 == 0).cast("int"))
    return T.usable_files(files, (18, 38), (63, 300), v.spark.createDataFrame([("2024-01-03",)], "raw_file string"), range(2007, 2016))


@query("a4_usable_surveys", "survey:i", "SELECT survey FROM school JOIN file USING (survey, raw_file) WHERE survey % 3 <> 0 GROUP BY ALL HAVING bool_or(category = 27) AND bool_or(category = 1)")
def usable_surveys(v: Survey) -> DataFrame:
    sv = v.sv.filter("survey % 3 <> 0 or freq_hz <> 120000")
    return T.usable_surveys(sv, v.school, [f * 1000 for f in FREQ_KHZ])


@query("a5_object_table", "survey:i object_id:i n:i", "SELECT survey, object_id % 200 AS object_id, count(*) AS n FROM school GROUP BY ALL HAVING count(*) > 1")
def object_table(v: Survey) -> DataFrame:
    """Objects written as CSV under their file names, read back, and tested for repeated ids."""
    from ..operators.objects import duplicated_ids

    path = _scratch(v, "objects-csv")
    raw = v.school.select("survey", (F.col("object_id") % 200).alias("object"), F.col("y0").alias("upperdeptindex"), F.col("y1").alias("lowerdeptindex"), F.col("x0").alias("startpingindex"), F.col("x1").alias("endpingindex"))
    raw.write.csv(path, header=True)
    return duplicated_ids(T.read_objects(v.spark, path))


@query(
    "a6_transect_ranges",
    "raw_file:s start:i stop:i",
    """SELECT t.raw_file, min(ping_idx) AS start, max(ping_idx) + 1 AS stop FROM (SELECT raw_file, date_trunc('second', t0) AS t0, date_trunc('second', t1) AS t1 FROM transect JOIN file USING (raw_file) WHERE n_pings % 2 = 0) t
       JOIN ping p ON p.raw_file = t.raw_file AND ping_time BETWEEN t0 AND t1 GROUP BY t.raw_file, t0
       UNION ALL SELECT raw_file, 0, n_pings FROM file WHERE n_pings % 2 <> 0 OR raw_file NOT IN (SELECT raw_file FROM transect)""",
)
def transect_ranges(v: Survey) -> DataFrame:
    """Transects written as CSV, read back, and turned into ping ranges of their files; files without transects are valid as a whole."""
    path = _scratch(v, "transects")
    even = v.transect.join(v.file.filter("n_pings % 2 = 0").select("raw_file"), "raw_file")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    even.select("raw_file", text("start_time").alias("StartDateTime"), text("stop_time").alias("StopDateTime")).write.csv(path, header=True)
    transects = T.read_transects(v.spark, path)
    return T.valid_ranges(v.file, T.transect_pings(transects, v.ping), transects)


@query(
    "a7_external_json",
    "ping_number:i low:d high:d us:i",
    "SELECT ping_number, min_m AS low, max_m AS high, epoch_us(CASE WHEN ping_number % 20 = 3 THEN date_trunc('millisecond', time) ELSE date_trunc('second', time) END) AS us FROM ext_mask",
)
def external_json(v: Survey) -> DataFrame:
    """External masks written as JSON with both time formats and read back."""
    path = _scratch(v, "mask-json")
    fraction = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.when(F.col("ping_number") % 20 == 3, fraction).otherwise(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    item = F.struct(text.alias("time"), F.col("ping_number").alias("pingNumber"), F.array(F.struct(F.col("min_m").alias("min"), F.col("max_m").alias("max"))).alias("depthRanges"))
    per_file = v.ext_mask.groupBy("raw_file").agg(F.to_json(F.collect_list(item)).alias("value")).select("value")
    per_file.write.option("maxRecordsPerFile", 1).text(path)
    got = T.read_external_mask(v.spark, path)
    return got.select(F.col("pingNumber").alias("ping_number"), F.col("depthRanges")[0]["min"].alias("low"), F.col("depthRanges")[0]["max"].alias("high"), F.unix_micros("time").alias("us"))


@query("a8_a9_resumed_predictions", "survey:i n:i total:d", "SELECT survey, count(DISTINCT (raw_file, ping_idx)) AS n, sum(p) AS total FROM pred GROUP BY ALL")
def resumed_predictions(v: Survey) -> DataFrame:
    """A run over part of the pings, then a run over all of them that adds the rest."""
    path = _scratch(v, "predictions")
    T.append_predictions(v.pred.filter("ping_idx % 3 = 0"), path)
    T.append_predictions(v.pred, path)
    return v.spark.read.parquet(path).groupBy("survey").agg(F.count("*").alias("n"), F.sum(F.aggregate("p_sandeel", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("a11_compacted", "raw_file:s n:i total:d", "SELECT raw_file, count(DISTINCT ping_idx) AS n, sum(p) AS total FROM pred GROUP BY ALL")
def compacted(v: Survey) -> DataFrame:
    path = _scratch(v, "compact")
    T.compact(v.pred, path, ["raw_file", "ping_idx"], 8)
    return v.spark.read.parquet(path).groupBy("raw_file").agg(F.count("*").alias("n"), F.sum(F.aggregate("p_sandeel", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(
    "a12_stacked_survey",
    "survey:i freq_hz:i n:i n_bins:i missing:i marked:i bottom:i",
    """SELECT survey, f * 1000 AS freq_hz, count(DISTINCT (raw_file, ping_idx)) AS n, max(r) + 1 AS n_bins, sum((isnan(v) OR short)::INT) AS missing, sum((label > 0 AND NOT short)::INT) AS marked, sum((r >= b)::INT) AS bottom
       FROM (SELECT s.*, survey, label, s.ping_idx % 2 = 0 AND s.r >= 40 AS short FROM sv s JOIN (SELECT survey, raw_file, ping_idx FROM ping) USING (raw_file, ping_idx) JOIN (SELECT raw_file, ping_idx, r, label FROM label) USING (raw_file, ping_idx, r)) GROUP BY ALL""",
)
def stacked_survey(v: Survey) -> DataFrame:
    """Files of profiles of two lengths, converted to survey cubes of data, labels and seabed masks, and stored."""
    path = _scratch(v, "survey-cube")
    rows = v.sv.select("survey", "raw_file", "ping_idx", "freq_hz", "sv")
    short = rows.filter("ping_idx % 2 = 0").withColumn("sv", F.slice("sv", 1, 40))
    cube = T.convert_survey([short, rows.filter("ping_idx % 2 = 1")], labelled(v).withColumn("labels", F.when(F.col("ping_idx") % 2 == 0, F.slice("labels", 1, 40)).otherwise(F.col("labels"))), v.seabed)
    cube.write.partitionBy("survey").parquet(path)
    count = lambda c, f: F.sum(F.size(F.filter(c, f)))
    return v.spark.read.parquet(path).groupBy("survey", "freq_hz").agg(
        F.count("*").alias("n"), F.max(F.size("sv")).alias("n_bins"), count("sv", F.isnan).alias("missing"), count("labels", lambda y: y > 0).alias("marked"), count("bottom", lambda m: m > 0).alias("bottom")
    )


#: Vectors as profiles of three raw files, in matrices of 16 pings, every fourth of which has another size than its manifest row says.
_PROFILES = """pf AS (SELECT 'd' || k % 3 AS raw_file, k // 3 AS ping_idx, embedding FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding FROM embeddings)),
pc AS (SELECT *, ping_idx // 16 AS piece, count(*) OVER (PARTITION BY raw_file, ping_idx // 16) AS n FROM pf)"""


def _ingested(v: Survey) -> tuple[str, str]:
    """Matrices written, described with faults, and ingested by a run that has only a part of them and one that has all."""
    k = F.col("vec_id") - F.lit(v.table("embeddings").agg(F.min("vec_id")).first()[0])
    sv = v.table("embeddings").select(F.concat(F.lit("d"), k % 3).alias("raw_file"), F.lit(38000).alias("freq_hz"), F.floor(k / 3).alias("ping_idx"), F.col("embedding").alias("sv"))
    path, target, bad = (_scratch(v, n) for n in ("matrices", "ingested", "quarantine"))
    manifest = write_matrices(sv, path, 16)
    fault = F.floor(F.col("first_ping") / 16) % 4 == 3
    manifest = manifest.withColumn("n_range", F.when(fault, F.col("n_range") + 1).otherwise(F.col("n_range")))
    ingest(v.spark, path, manifest.filter("first_ping % 32 = 0"), target, bad, 1 << 10)
    ingest(v.spark, path, manifest, target, bad, 1 << 11)
    return target, bad


@query(
    "a2_ingested_matrices",
    "raw_file:s ping_idx:i bins:i total:d",
    "SELECT raw_file, ping_idx, len(embedding) AS bins, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * embedding[i]::DOUBLE)) AS total FROM pc WHERE piece % 4 <> 3",
    _PROFILES,
)
def ingested_matrices(v: Survey) -> DataFrame:
    rows = v.spark.read.parquet(_ingested(v)[0])
    weighted = F.aggregate(F.transform("sv", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("raw_file", "ping_idx", F.size("sv").alias("bins"), weighted.alias("total"))


@query("a13_quarantined_matrices", "source:s lo:i reason:s", """SELECT DISTINCT printf('%s/38000/%08d.dat', raw_file, piece) AS source, lo, 'size does not fit' AS reason FROM pc, (SELECT unnest([0, 7, 14]) AS lo) WHERE piece % 4 = 3 AND lo < n""", _PROFILES)
def quarantined_matrices(v: Survey) -> DataFrame:
    return v.spark.read.parquet(_ingested(v)[1])


_FILES = "fl AS (SELECT o_orderkey AS stem, o_custkey % 13 AS cruise, o_orderkey % 3 <> 0 AS snap, o_orderkey % 5 <> 0 AS work, o_orderkey % 4 <> 0 AS std FROM orders)"


def _files(v: Survey) -> DataFrame:
    k = F.col("o_orderkey")
    return v.table("orders").select(k.alias("stem"), (F.col("o_custkey") % 13).alias("cruise"), (k % 3 != 0).alias("snap"), (k % 5 != 0).alias("work"), (k % 4 != 0).alias("std_loc"))


@query(
    "a14_inventory",
    "cruise:i raw_std:i raw_other:i snap_std:i snap_other:i work_std:i work_other:i",
    """SELECT cruise, count(*) FILTER (std) AS raw_std, count(*) FILTER (NOT std) AS raw_other, count(*) FILTER (snap AND std) AS snap_std, count(*) FILTER (snap AND NOT std) AS snap_other,
       count(*) FILTER (work AND std) AS work_std, count(*) FILTER (work AND NOT std) AS work_other FROM fl GROUP BY ALL""",
    _FILES,
)
def inventory(v: Survey) -> DataFrame:
    f = _files(v)
    kinds = F.array_compact(F.array(F.lit("raw"), F.when(F.col("snap"), "snap"), F.when(F.col("work"), "work")))
    return T.inventory(f.select("cruise", "std_loc", F.explode(kinds).alias("kind")))


@query("a15_paired_files", "stem:i has_work:b", "SELECT stem, work AS has_work FROM fl WHERE snap", _FILES)
def paired_files(v: Survey) -> DataFrame:
    f = _files(v)
    return T.paired_files(f, f.filter("snap"), f.filter("work"))


@query("a16_worklist", "stem:i code:i", "SELECT stem, CASE WHEN stem % 6 < 3 THEN 0 ELSE -2 END AS code FROM fl WHERE stem % 6 <> 4 OR stem % 7 = 0", _FILES)
def worklist(v: Survey) -> DataFrame:
    """Stems 3 to 5 modulo 6 have a status: failed (-2), but those with 4 ended well unless a multiple of 7."""
    f = _files(v).select("stem")
    tried = f.filter("stem % 6 >= 3")
    status = tried.select("stem", F.lit(1).alias("at"), F.lit(-1).alias("code")).unionByName(
        tried.select("stem", F.lit(2).alias("at"), F.when((F.col("stem") % 6 == 4) & (F.col("stem") % 7 != 0), 1).otherwise(-2).alias("code"))
    )
    return T.worklist(f, status)


@query(
    "g5_g6_chains",
    "class:i n:i total:d",
    """SELECT class, count(*) AS n, sum(CASE WHEN isnan(v) THEN 0 ELSE greatest(least(10 * log10(v + 1e-10), 0), -75) END) AS total FROM (SELECT v, CASE WHEN isnan(v) THEN -100 WHEN label = 0 AND s.r >= s.b + 10 THEN -50 WHEN label = 0 THEN 0 WHEN label = 27 THEN 1 WHEN label = 1 THEN 2 ELSE -10 END AS class
       FROM sv s JOIN label USING (raw_file, ping_idx, r)) GROUP BY ALL""",
)
def chains(v: Survey) -> DataFrame:
    """Test chains: labels to classes, seabed code, missing cells ignored; then decibels and border."""
    rows = v.sv.join(labelled(v), ["raw_file", "ping_idx"]).join(v.seabed.drop("survey"), ["raw_file", "ping_idx"])
    rows = rows.withColumn("labels", F.transform("labels", A.species_class_other)).withColumn("labels", L.seabed_masked("labels", F.col("seabed_idx")))
    rows = jobs.prepared(rows.withColumn("labels", A.labels_without_missing("labels", "sv")))
    cells = rows.select(F.explode(F.arrays_zip("labels", "sv")).alias("c"))
    return cells.groupBy(F.col("c.labels").alias("class")).agg(F.count("*").alias("n"), F.sum("c.sv").alias("total"))


def _chained_sql(label: str, result: str) -> str:
    """Patches of 64 x 32 cells at all valid schools; `label` is what the border is refined on, `result` the class of a cell."""
    return f"""disc AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy * dy + dx * dx <= 10),
pt AS (SELECT raw_file, object_id AS patch_id, y0 AS cy, x0 AS cx FROM school WHERE category <> -1 AND x0 <= x1),
pc AS (SELECT raw_file, patch_id, x, y, x + cx - 16 + 1 AS ping_idx, y + cy - 32 + 1 AS r FROM pt, (SELECT unnest(range(32)) AS x), (SELECT unnest(range(64)) AS y)),
pl AS (SELECT pc.*, l.b, s.v, CASE WHEN l.label IS NULL THEN -100 ELSE {label} END AS y0 FROM pc LEFT JOIN label l USING (raw_file, ping_idx, r)
  LEFT JOIN (SELECT raw_file, ping_idx, r, v FROM sv WHERE f = 200) s USING (raw_file, ping_idx, r)),
box AS (SELECT patch_id, min(ping_idx) AS p0, max(ping_idx) AS p1, min(r) AS r0, max(r) AS r1 FROM pl WHERE y0 <> -100 GROUP BY ALL),
seed AS (SELECT patch_id, ping_idx, r FROM pl WHERE y0 > 0 AND NOT isnan(v) AND v > 1e-7::DOUBLE AND v < 4e-6::DOUBLE),
grown AS (SELECT DISTINCT patch_id, ping_idx + dx AS ping_idx, r + dy AS r FROM seed JOIN box USING (patch_id), disc WHERE ping_idx + dx BETWEEN p0 AND p1 AND r + dy BETWEEN r0 AND r1),
closed AS (SELECT patch_id, ping_idx + dx AS ping_idx, r + dy AS r, true AS own FROM grown, disc GROUP BY ALL HAVING count(*) = 37),
refined AS (SELECT pl.*, CASE WHEN y0 > 0 AND own IS NULL THEN -30 ELSE y0 END AS y1 FROM pl LEFT JOIN closed USING (patch_id, ping_idx, r)),
done AS (SELECT patch_id, {result} AS class FROM refined)"""


_CLASSES = "SELECT patch_id, class, count(*) AS n FROM done GROUP BY ALL"


def _school_classes(v: Survey, recipe: Recipe) -> DataFrame:
    patches = v.school.filter("category <> -1 and x0 <= x1").select("raw_file", F.col("object_id").alias("patch_id"), F.col("object_id").alias("key"), F.col("y0").alias("cy"), F.col("x0").alias("cx"))
    cells = patch_labels(patches, recipe, v.blocks, labelled(v), v.seabed, v.ping)
    return cells.groupBy("patch_id", F.col("label").alias("class")).agg(F.count("*").alias("n"))


@query("g5_training_chain", "patch_id:i class:i n:i", _CLASSES, _chained_sql("l.label", "CASE y1 WHEN 0 THEN 0 WHEN 27 THEN 1 WHEN 1 THEN 2 ELSE -100 END"))
def training_chain(v: Survey) -> DataFrame:
    """Borders are refined before species become classes."""
    return _school_classes(v, Recipe((200_000,), 64, 32, "train", low=1e-7, high=4e-6))


@query(
    "g5_evaluation_chain",
    "patch_id:i class:i n:i",
    _CLASSES,
    _chained_sql(
        "CASE l.label WHEN 0 THEN 0 WHEN 27 THEN 1 WHEN 1 THEN 2 ELSE -10 END",
        "CASE WHEN y1 <> -100 AND (x < 4 OR x >= 28 OR y < 4 OR y >= 60) THEN -70 WHEN y1 = 0 AND r >= b + 10 THEN -50 ELSE y1 END",
    ),
)
def evaluation_chain(v: Survey) -> DataFrame:
    """Classes, refined borders, seabed and overlap codes, in this order."""
    return _school_classes(v, Recipe((200_000,), 64, 32, "evaluate", overlap=4, low=1e-7, high=4e-6))


@query(
    "m2_tiled_prediction",
    "raw_file:s n:i total:d",
    """SELECT raw_file, count(DISTINCT ping_idx) AS n, sum(CASE WHEN r < cov THEN exp(a / 20) / (1 + exp(a / 20) + exp(b / 20)) ELSE 0 END) AS total FROM (
       SELECT raw_file, ping_idx, r, max(d) FILTER (f = 18) AS a, max(d) FILTER (f = 38) AS b FROM (
         SELECT *, greatest(least(10 * log10(CASE WHEN isnan(v) THEN 0 ELSE v END + 1e-10), 0), -75) AS d FROM sv) GROUP BY ALL) JOIN lim USING (raw_file) GROUP BY ALL""",
    "lim AS (SELECT raw_file, CASE WHEN max(b) + 50 <= 48 THEN 48 ELSE 64 END AS cov FROM ping GROUP BY ALL)",
)
def tiled_prediction(v: Survey) -> DataFrame:
    """Tiles, crops, a fixed linear model, scatter: each ping comes back once, with the scores of its own cells."""
    names = [f * 1000 for f in FREQ_KHZ]
    model = lambda x: np.column_stack([np.zeros(len(x)), x[:, 0] / 20, x[:, 1] / 20])
    out = jobs.predict_survey(v.file, v.sv, labelled(v), v.seabed, names, model, 64, 8, 64)
    return out.groupBy("raw_file").agg(F.count("*").alias("n"), F.sum(F.aggregate("p_sandeel", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("m6_patch_data", "patch_id:i cells:i labelled:i", "SELECT patch_id, count(*) AS cells, sum((coalesce(label, 0) = 27)::INT) AS labelled FROM pc LEFT JOIN label USING (raw_file, ping_idx, r) GROUP BY ALL", """pt AS (SELECT raw_file, object_id AS patch_id, y0 AS cy, x0 AS cx FROM school WHERE category <> -1 AND x0 <= x1),
pc AS (SELECT raw_file, patch_id, x + cx - 16 + 1 AS ping_idx, y + cy - 16 + 1 AS r FROM pt, (SELECT unnest(range(32)) AS x), (SELECT unnest(range(32)) AS y))""")
def patch_data(v: Survey) -> DataFrame:
    patches = v.school.filter("category <> -1 and x0 <= x1").select("raw_file", F.col("object_id").alias("patch_id"), F.col("y0").alias("cy"), F.col("x0").alias("cx"))
    cols = jobs.patch_cells(patches, v.sv, labelled(v), [f * 1000 for f in FREQ_KHZ], 32, 32)
    return cols.groupBy("patch_id").agg(F.sum(F.size("labels")).alias("cells"), F.sum(F.size(F.filter("labels", lambda y: y == 27))).alias("labelled"))


def _patch_sql(size: int, seed: int | None, label: str, result: str, scaled: bool, border: str, meta: bool) -> str:
    """cell(patch_id, channel, i, val): all channels and labels of the patches pt(patch_id, raw_file, cy, cx), cell i = y * size + x."""
    h = size // 2
    cells = size * size
    u = lambda key, k: _U(key, (seed or 0) + k)
    on = f"{u('patch_id', 0)} < 0.5" if seed is not None else "false"
    flip = f"CASE WHEN {u('patch_id', 4)} < 0.5 THEN {size - 1} - x ELSE x END" if seed is not None else "x"
    key = f"patch_id * {4 * cells} + k * {cells} + y * {size} + x"
    db = "greatest(least(10 * log10(w + 1e-10), 0), -75)"
    value = f"1 + {db} / 75" if scaled else db
    planes = "" if not meta else f"""
  UNION ALL SELECT patch_id, c, y * {size} + {flip}, val::FLOAT::DOUBLE FROM (SELECT patch_id, x, y, unnest(['portion_year', 'sin_day', 'cos_day', 'time_diff', 'depth_rel', 'depth_abs_surface', 'depth_abs_seabed']) AS c,
    unnest([yr, sin(2 * pi() * td), cos(2 * pi() * td), diff, (cy - {h} + y) / b::DOUBLE, (cy - {h} + y) / {size}.0::DOUBLE, (b - (cy - {h} + y)) / {size}.0::DOUBLE]) AS val
    FROM pt JOIN ends USING (raw_file) CROSS JOIN (SELECT unnest(range({size})) AS x) CROSS JOIN (SELECT unnest(range({size})) AS y)
    JOIN (SELECT raw_file, ping_idx AS mid, (d + 719529) - floor(d + 719529) AS td FROM day) m ON m.raw_file = pt.raw_file AND mid = greatest(0, least(cx, last))
    JOIN (SELECT raw_file, ping_idx AS col, diff, b FROM day) k ON k.raw_file = pt.raw_file AND col = greatest(0, least(cx - {h} + x, last)))"""
    return f"""disc AS (SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE dy * dy + dx * dx <= 10),
day AS (SELECT raw_file, ping_idx, b, d, (CASE WHEN lag(d) OVER w IS NULL THEN lead(d) OVER w - d WHEN lead(d) OVER w IS NULL THEN d - lag(d) OVER w ELSE (lead(d) OVER w - lag(d) OVER w) / 2 END) / 6e-3::DOUBLE - 1 AS diff
  FROM (SELECT *, epoch_us(ping_time) / 86400e6::DOUBLE AS d FROM ping) WINDOW w AS (PARTITION BY raw_file ORDER BY ping_idx)),
ends AS (SELECT raw_file, max(ping_idx) AS last, month(min(ping_time)) / 12.0::DOUBLE + day(min(ping_time)) / 366.0::DOUBLE + hour(min(ping_time)) / 366.0::DOUBLE / 24 AS yr FROM ping GROUP BY ALL),
pc AS (SELECT pt.*, x, y, x + cx - {h} + 1 AS ping_idx, y + cy - {h} + 1 AS r FROM pt, (SELECT unnest(range({size})) AS x), (SELECT unnest(range({size})) AS y)),
raw AS (SELECT pc.patch_id, x, y, k, kf, CASE WHEN v IS NULL OR isnan(v) THEN 0 ELSE v END AS v FROM pc CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k, unnest([18, 38, 120, 200]) AS kf)
  LEFT JOIN sv s ON s.raw_file = pc.raw_file AND s.ping_idx = pc.ping_idx AND s.r = pc.r AND f = kf),
val AS (SELECT patch_id, x, y, k, kf, CASE WHEN NOT {on} THEN v WHEN {u(key, 1)} < 0.025 THEN v * (1 + 9 * {u(key, 2)}) WHEN {u(key, 1)} < 0.05 THEN v * {u(key, 2)} ELSE v END AS w FROM raw),
pl AS (SELECT pc.patch_id, x, y, pc.r, l.b, w AS v, CASE WHEN l.label IS NULL THEN -100 ELSE {label} END AS y0 FROM pc LEFT JOIN label l USING (raw_file, ping_idx, r) JOIN (SELECT * FROM val WHERE k = 3) USING (patch_id, x, y)),
box AS (SELECT patch_id, min(x) AS p0, max(x) AS p1, min(y) AS r0, max(y) AS r1 FROM pl WHERE y0 <> -100 GROUP BY ALL),
seed AS (SELECT patch_id, x, y FROM pl WHERE y0 > 0 AND v > 1e-7::DOUBLE AND v < 4e-6::DOUBLE),
grown AS (SELECT DISTINCT patch_id, x + dx AS x, y + dy AS y FROM seed JOIN box USING (patch_id), disc WHERE x + dx BETWEEN p0 AND p1 AND y + dy BETWEEN r0 AND r1),
closed AS (SELECT patch_id, x + dx AS x, y + dy AS y, true AS own FROM grown, disc GROUP BY ALL HAVING count(*) = 37),
refined AS (SELECT pl.*, CASE WHEN y0 > 0 AND own IS NULL THEN -30 ELSE y0 END AS y1 FROM pl LEFT JOIN closed USING (patch_id, x, y)),
done AS (SELECT patch_id, x, y, {result} AS class FROM refined),
cell AS (SELECT patch_id, 'f' || kf * 1000 AS channel, y * {size} + {flip} AS i, CASE WHEN {border} THEN 0 ELSE {value} END::FLOAT::DOUBLE AS val FROM val JOIN done USING (patch_id, x, y)
  UNION ALL SELECT patch_id, 'labels', y * {size} + {flip}, class FROM done{planes})"""


_PATCH_TOTALS = "SELECT patch_id, channel, count(*) AS n, avg(val * (1 + i % 7)) AS total FROM cell GROUP BY ALL"
_TRAIN = Recipe(tuple(1000 * f for f in FREQ_KHZ), 32, 32, "train", META, True, 90, low=1e-7, high=4e-6, unit=6e-3)
_TRAIN_SQL = _patch_sql(32, 90, "l.label", "CASE y1 WHEN 0 THEN 0 WHEN 27 THEN 1 WHEN 1 THEN 2 ELSE -100 END", True, "false", True)
_EVALUATED = Recipe(tuple(1000 * f for f in FREQ_KHZ), 32, 32, "evaluate", overlap=4, low=1e-7, high=4e-6)
_EVALUATED_SQL = _patch_sql(
    32,
    None,
    "CASE l.label WHEN 0 THEN 0 WHEN 27 THEN 1 WHEN 1 THEN 2 ELSE -10 END",
    "CASE WHEN y1 <> -100 AND (x < 4 OR x >= 28 OR y < 4 OR y >= 28) THEN -70 WHEN y1 = 0 AND r >= b + 10 THEN -50 ELSE y1 END",
    False,
    "class = -100",
    False,
)


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """patch_id, channel, cells -> patch_id, channel, n and the sum of cell i times 1 + i % 7; an Arrow batch is at most 10,000 channels."""
    for batch in batches:
        cells = batch.column("cells")
        size = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(size) - size
        flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        total = np.add.reduceat(flat * (1 + (np.arange(len(flat)) - np.repeat(at, size)) % 7), at) if len(flat) else np.zeros(len(size))
        yield pa.RecordBatch.from_arrays([batch.column("patch_id"), batch.column("channel"), pa.array(size), pa.array(total)], ["patch_id", "channel", "n", "total"])


def _stored_patches(v: Survey, patches: DataFrame, recipe: Recipe) -> DataFrame:
    """patch_id, channel, n, total of patches stored by two runs, of which the first had the surveys up to 2012 only."""
    path = _scratch(v, "patches")
    early = patches.join(v.file.filter("survey <= 2012").select("raw_file"), "raw_file", "left_semi")
    for part in (early, patches):
        store_patches(part, path, lambda p: patch_set(p, recipe, v.blocks, labelled(v), v.seabed, v.ping))
    rows = v.spark.read.parquet(path)
    names = F.array(*map(F.lit, recipe.channels()))
    data = rows.select("patch_id", F.posexplode("data").alias("k", "cells")).select("patch_id", F.get(names, F.col("k")).alias("channel"), "cells")
    data = data.unionByName(rows.select("patch_id", F.lit("labels").alias("channel"), F.col("labels").cast("array<float>").alias("cells")))
    kind = rows.schema["patch_id"].dataType.simpleString()
    sums = data.mapInArrow(_weighted_sums, f"patch_id {kind}, channel string, n long, total double")
    return sums.groupBy("patch_id", "channel").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("total"))


@query(
    "m6_training_patches",
    "patch_id:i channel:s n:i total:d",
    _PATCH_TOTALS,
    _drawn_sql(11, "(SELECT object_id AS draw_id FROM school)", 32) + ", pt AS (SELECT draw_id AS patch_id, raw_file, cy, cx FROM drawn), " + _TRAIN_SQL,
)
def training_patches(v: Survey) -> DataFrame:
    """As many draws of the sampler mixture as objects, with metadata planes, noise, flips, the training chain and scaled decibels."""
    # the centres are a table of their own: every part of a patch is joined to them
    drawn = written(_draws(v, 11, 32, v.school.select(F.col("object_id").alias("draw_id"))).filter("raw_file is not null"))
    return _stored_patches(v, drawn.select("raw_file", F.col("draw_id").alias("patch_id"), F.col("draw_id").alias("key"), "cy", "cx"), _TRAIN)


@query(
    "m6_evaluation_patches",
    "patch_id:i channel:s n:i total:d",
    _PATCH_TOTALS,
    f"""pt AS (SELECT object_id * 2 AS patch_id, raw_file, y0 AS cy, x0 AS cx FROM school WHERE category <> -1 AND x0 <= x1
  UNION ALL SELECT e * 2 + 1, raw_file, cy, cx FROM (SELECT e, raw_file, floor({_U('e', 21)} * (b - 16))::BIGINT AS cy, ping_idx AS cx FROM ping WHERE b > 16) c WHERE {_CLEAR}), """ + _EVALUATED_SQL,
)
def evaluation_patches(v: Survey) -> DataFrame:
    """Patches at all valid schools and all clear background centres under the evaluation chain."""
    schools = v.school.filter("category <> -1 and x0 <= x1").select("raw_file", (F.col("object_id") * 2).alias("patch_id"), F.col("y0").alias("cy"), F.col("x0").alias("cx"))
    clear = P.without_labels(P.background_centres(_pings(v), 21, 32), v.school.filter("x0 <= x1 and category <> -1"), 32, 32)
    clear = clear.join(v.ping.select("raw_file", F.col("ping_idx").alias("cx"), "e"), ["raw_file", "cx"]).select("raw_file", (F.col("e") * 2 + 1).alias("patch_id"), "cy", "cx")
    return _stored_patches(v, written(schools.unionByName(clear).withColumn("key", F.col("patch_id"))), _EVALUATED)


@query("m3_m4_trained_cells", "raw_file:s n:i sure:b")
def trained_cells(v: Survey) -> DataFrame:
    """A class-weighted classifier of cells, fitted on 2007 to 2012 and applied to all files."""
    names = [f"f{f}" for f in FREQ_KHZ]
    rows = jobs.profiles_by_ping(v.sv, [f * 1000 for f in FREQ_KHZ], names, "survey").hint("merge").join(v.beside_profiles(labelled(v)), ["raw_file", "ping_idx"])
    cells = rows.filter("survey <= 2012").select(F.explode(F.arrays_zip(*names, "labels")).alias("c"))
    cells = cells.select(A.species_class(F.col("c.labels")).alias("label"), *[A.db_clipped(A.without_non_finite(F.col(f"c.{n}"))).alias(n) for n in names])
    model = jobs.train_cells(cells, names, rounds=5)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scored = jobs.score_profiles(rows, names, lambda x: x @ weights.T + bias)
    total = F.zip_with(F.zip_with("p0", "p1", lambda a, b: a + b), "p2", lambda a, b: a + b)
    return scored.groupBy("raw_file").agg(F.sum(F.size("p0")).alias("n"), F.bool_and(F.forall(total, lambda x: F.abs(x - 1) < 1e-9)).alias("sure"))


@query("s1_incremental_run", "survey:i n:i", "SELECT survey, count(*) AS n FROM ping GROUP BY ALL")
def incremental_run(v: Survey) -> DataFrame:
    """Two runs over a growing folder: the second one takes the new files only."""
    source, sink, mark = (_scratch(v, n) for n in ("incoming", "scored", "marks"))
    rows = v.pred.select("survey", "raw_file", "ping_idx")
    for part in ("ping_idx % 2 = 0", "ping_idx % 2 = 1"):
        rows.filter(part).coalesce(4).write.mode("append").parquet(source)
        run_new_files(v.spark, source, rows.schema, lambda df: df.withColumn("scored", F.lit(True)), sink, mark)
    return v.spark.read.parquet(sink).groupBy("survey").agg(F.count("*").alias("n"))


_NEAR = """tile AS (SELECT raw_file, i * 24 - 5 + 16 AS cx, j * 24 - 5 + 16 AS cy FROM (SELECT raw_file, count(*) AS n, least(64, max(b) + 5) AS h FROM ping GROUP BY ALL), (SELECT unnest(range(2000)) AS i), (SELECT unnest(range(10)) AS j) WHERE i * 24 <= n - 1 AND j * 24 <= h - 1),
good AS (SELECT * FROM school WHERE x0 <= x1 AND category <> -1),
near AS (SELECT s.raw_file, object_id, [arg_min(cx, (abs(cx - x0), cx)), arg_min(cx, (abs(cx - x1), cx))] AS xs, [arg_min(cy, (abs(cy - y0), cy)), arg_min(cy, (abs(cy - y1), cy))] AS ys FROM good s JOIN tile t ON s.raw_file = t.raw_file GROUP BY 1, 2),
pt AS (SELECT row_number() OVER () AS patch_id, * FROM (
  SELECT DISTINCT 'region' AS mode, raw_file, cy, cx FROM (SELECT raw_file, unnest(xs) AS cx, ys FROM near), unnest(ys) AS u(cy)
  UNION ALL SELECT DISTINCT 'trace', raw_file, cy, cx FROM (SELECT raw_file, unnest(xs) AS cx FROM near) JOIN (SELECT DISTINCT raw_file, cy FROM tile) USING (raw_file))), """
_AROUND = """,
marked AS (SELECT mode, pc.raw_file, pc.ping_idx, pc.r, class, CASE mode WHEN 'trace' THEN EXISTS (SELECT 1 FROM good g WHERE g.raw_file = pc.raw_file AND pc.ping_idx >= x0 - 3 AND pc.ping_idx < x1 + 3)
  ELSE EXISTS (SELECT 1 FROM good g WHERE g.raw_file = pc.raw_file AND pc.ping_idx >= x0 - 3 AND pc.ping_idx < x1 + 3 AND pc.r >= y0 - 3 AND pc.r < y1 + 3) END AS hit FROM pc JOIN done USING (patch_id, x, y)),
coded AS (SELECT survey, mode, compat, CASE WHEN hit THEN class WHEN compat THEN -1 ELSE -100 END AS y, p FROM marked JOIN pred USING (raw_file, ping_idx, r), (SELECT unnest([false, true]) AS compat)),
each AS (SELECT survey, mode, compat, CASE WHEN y = -50 OR p = 0 THEN 0 ELSE round_even(p / u, 0) * u END AS score, y = 1 AS positive FROM (SELECT *, pow(2, greatest(floor(log2(CASE WHEN p > 0 THEN p END)), -14) - 10) AS u FROM coded) WHERE y NOT IN (-70, -30, -100, -10)),
cnt AS (SELECT survey, mode, compat, score, sum(positive::INT) AS p, count(*) AS n FROM each GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY survey, mode, compat) AS total FROM cnt WINDOW w AS (PARTITION BY survey, mode, compat ORDER BY score DESC)),
full_ AS (SELECT survey, mode, compat, max(score) AS cut FROM cum WHERE tp = total GROUP BY ALL),
pr AS (SELECT survey, mode, compat, score AS threshold, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (seen + total) ELSE 0 END, 12) AS f1, seen FROM cum JOIN full_ USING (survey, mode, compat) WHERE score >= cut)"""


@query(
    "m5_region_and_trace_evaluation",
    "survey:i mode:s compat:b cells:i f1:d threshold:d",
    "SELECT survey, mode, compat, any_value(cells) AS cells, max(f1) AS f1, arg_min(threshold, (-f1, threshold)) AS threshold FROM pr JOIN (SELECT survey, mode, compat, sum(n) AS cells FROM cnt GROUP BY ALL) USING (survey, mode, compat) GROUP BY ALL",
    _NEAR + _EVALUATED_SQL + _AROUND,
)
def region_and_trace_evaluation(v: Survey) -> DataFrame:
    """Tiles near objects under the evaluation chain and the region or trace mask; scores in half precision, 0 below the seabed; the best F1 of each survey."""
    recipe = Recipe((200_000,), 32, 32, "evaluate", overlap=4, low=1e-7, high=4e-6)
    objects, grid, parts = written(v.school.filter("x0 <= x1 and category <> -1")), S.tiles(v.file, v.seabed, 32, 4, margin=5), []
    for mode in ("region", "trace"):
        tiles = written(S.tiles_at_objects(grid, objects, mode == "trace"))
        parts.append(patch_columns(tiles.withColumn("key", F.lit(0)), recipe, v.blocks, labelled(v), v.seabed, v.ping).withColumn("mode", F.lit(mode)))
    scores = v.pred.select("survey", "raw_file", "ping_idx", half_precision_profile("p_sandeel").alias("p"))
    by = ["survey", "mode", "compat"]
    counts = written(masked_counts(parts[0].unionByName(parts[1]), L.object_spans(objects, 3), L.object_pings(objects, 3), scores, recipe.height))
    curve = counted_curve(counts, by).withColumn("f1", F.round("f1", 12))
    return best_f1(curve, by).join(counts.groupBy(*by).agg(F.sum("n").alias("cells")), by).select(*by, "cells", "f1", "threshold")


_PREDICTION = Recipe(tuple(1000 * f for f in FREQ_KHZ), 32, 32, "evaluate", overlap=4, low=1e-7, high=4e-6)
#: A model that looks at its neighbour pings, so that tiles, their overlap and the ends of splits matter.
_PREDICTED = """lim AS (SELECT raw_file, n_pings, ceil(n_pings / 100.0) AS pieces FROM file),
cut AS (SELECT raw_file, ping_idx, k FROM ping JOIN (SELECT raw_file, k, floor(k * n_pings / pieces) AS lo, floor((k + 1) * n_pings / pieces) AS hi FROM lim, (SELECT unnest(range(1000)) AS k) WHERE k < pieces) s USING (raw_file) WHERE ping_idx >= lo AND ping_idx < hi),
d AS (SELECT sv.raw_file, k, sv.ping_idx, r, b, f, greatest(least(10 * log10(CASE WHEN isnan(v) THEN 0 ELSE v END + 1e-10), 0), -75)::FLOAT::DOUBLE AS d FROM sv JOIN cut USING (raw_file, ping_idx) WHERE f IN (18, 38)),
w AS (SELECT *, d + coalesce(lag(d) OVER o, 0) + coalesce(lead(d) OVER o, 0) AS s FROM d WINDOW o AS (PARTITION BY raw_file, k, f, r ORDER BY ping_idx)),
sc AS (SELECT raw_file, ping_idx, r, any_value(b) AS b, max(s) FILTER (f = 18) / 60 AS s1, max(d) FILTER (f = 38) / 20 AS s2 FROM w GROUP BY ALL),
pr AS (SELECT sc.raw_file, sc.ping_idx, sc.r, CASE WHEN label = 0 AND sc.r >= sc.b + 10 THEN 0 ELSE exp(s1) / (1 + exp(s1) + exp(s2)) END AS p1, CASE WHEN label = 0 AND sc.r >= sc.b + 10 THEN 0 ELSE exp(s2) / (1 + exp(s1) + exp(s2)) END AS p2 FROM sc JOIN label USING (raw_file, ping_idx, r)),
half AS (SELECT raw_file, ping_idx, r, CASE WHEN p1 = 0 THEN 0 ELSE round_even(p1 / u1, 0) * u1 END AS h1, CASE WHEN p2 = 0 THEN 0 ELSE round_even(p2 / u2, 0) * u2 END AS h2 FROM (
  SELECT *, pow(2, greatest(floor(log2(CASE WHEN p1 > 0 THEN p1 END)), -14) - 10) AS u1, pow(2, greatest(floor(log2(CASE WHEN p2 > 0 THEN p2 END)), -14) - 10) AS u2 FROM pr))"""


def _neighbour_model(x: np.ndarray) -> np.ndarray:
    a, wide = x[:, 0].astype(float), np.pad(x[:, 0].astype(float), ((0, 0), (0, 0), (1, 1)))
    return np.stack([np.zeros_like(a), (a + wide[:, :, :-2] + wide[:, :, 2:]) / 60, x[:, 1].astype(float) / 20], axis=1)


@query("m2_s1_prediction_stream", "raw_file:s ping_idx:i n:i sandeel:d other:d", "SELECT raw_file, ping_idx, count(*) AS n, sum(h1) AS sandeel, sum(h2) AS other FROM half GROUP BY ALL", _PREDICTED)
def prediction_stream(v: Survey) -> DataFrame:
    """Announced files are predicted by a stream: a first run over some, a run that fails before its commit, and a last one."""
    source, mark, sink, manifest = (_scratch(v, n) for n in ("announced", "marks", "predicted", "manifest"))
    files = v.file.select("raw_file", "n_pings", "n_range")
    work = lambda f: predicted(f, v.blocks, labelled(v), v.seabed, v.ping, _PREDICTION, _neighbour_model, 100)
    run = lambda w: predict_new_files(v.spark, source, "raw_file string, n_pings int, n_range int", mark, sink, manifest, w)
    files.filter("n_pings % 3 = 0").coalesce(1).write.parquet(source)
    run(work)
    # rows of files that are written but never named in the manifest do not count
    work(files.filter("n_pings % 3 = 1")).withColumn("run", F.lit("lost")).write.mode("append").parquet(sink)
    files.filter("n_pings % 3 > 0").coalesce(1).write.mode("append").parquet(source)
    run(work)
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return committed(v.spark, sink, manifest).select("raw_file", "ping_idx", F.size("p_sandeel").alias("n"), total("p_sandeel").alias("sandeel"), total("p_other").alias("other"))


@query("a1_opened_survey", "survey:i raw_file:s pings:i freqs:i marked:i", "SELECT p.survey, p.raw_file, count(DISTINCT p.ping_idx) AS pings, count(DISTINCT f) AS freqs, count(DISTINCT l.ping_idx) AS marked FROM ping p JOIN (SELECT DISTINCT raw_file, ping_idx, f FROM sv) s ON s.raw_file = p.raw_file AND s.ping_idx = p.ping_idx LEFT JOIN (SELECT DISTINCT raw_file, ping_idx FROM lay) l ON l.raw_file = p.raw_file AND l.ping_idx = p.ping_idx GROUP BY ALL")
def opened_survey(v: Survey) -> DataFrame:
    """Profiles with their optional annotation and seabed."""
    marks = S.mask_coordinates(v.annotation, "mask").select("raw_file", "ping_idx").distinct().withColumn("m", F.lit(1))
    profiles = v.sv.groupBy("survey", "raw_file", "ping_idx").agg(F.count("*").alias("k"))
    rows = profiles.join(v.seabed.drop("survey"), ["raw_file", "ping_idx"], "left").join(marks, ["raw_file", "ping_idx"], "left")
    return rows.groupBy("survey", "raw_file").agg(F.count("*").alias("pings"), F.max("k").alias("freqs"), F.count("m").alias("marked"))


@query("a10_metrics", "survey:i n:i threshold:d f1:d", "SELECT survey, count(threshold) AS n, max(threshold) AS threshold, max(f1) AS f1 FROM pr GROUP BY ALL", SCORED)
def metrics(v: Survey) -> DataFrame:
    """Precision-recall curves, written as one CSV with an empty last threshold, and read back."""
    path = _scratch(v, "metrics")
    precision_recall(scored(v), ["survey"]).write.csv(path, header=True)
    curve = v.spark.read.csv(path, header=True, schema="survey int, threshold double, precision double, recall double, f1 double")
    return curve.groupBy("survey").agg(F.count("threshold").alias("n"), F.max("threshold").alias("threshold"), F.max("f1").alias("f1"))


@query("a17_a18_files_left", "raw_file:s", "SELECT raw_file FROM file WHERE n_pings % 3 <> 0")
def files_left(v: Survey) -> DataFrame:
    """Files whose shifted labels or seabed are not stored yet."""
    return T.new_rows(v.file, v.file.filter("n_pings % 3 = 0"), ["raw_file"])


@query(
    "a17_stored_heave_labels",
    "raw_file:s label:i n:i weight:i",
    """SELECT l.raw_file, label, count(*) AS n, sum((l.r - h + 1) * (ping_idx + 1)) AS weight FROM (SELECT *, round_even(((e * 7) % 11 - 5) * 0.6::DOUBLE / 0.5, 0)::INT AS h FROM label WHERE label > 0) l
       WHERE l.r - h BETWEEN 0 AND 63 GROUP BY ALL""",
)
def stored_heave_labels(v: Survey) -> DataFrame:
    """Labels without heave, stored file by file: a first run over a part of the files, a second adds the others."""
    path = _scratch(v, "heave-labels")
    rows = labelled(v).join(v.ping.select("raw_file", "ping_idx", "heave_m"), ["raw_file", "ping_idx"])
    first = rows.join(v.file.filter("n_pings % 3 = 0").select("raw_file"), "raw_file", "left_semi")
    for part in (first, rows):
        jobs.store_new_files(part, path, lambda r: jobs.without_heave(r, 0.5))
    cells = v.spark.read.parquet(path).select("raw_file", "ping_idx", F.posexplode("labels").alias("r", "label")).filter("label > 0")
    return cells.groupBy("raw_file", "label").agg(F.count("*").alias("n"), F.sum((F.col("r") + 1) * (F.col("ping_idx") + 1)).alias("weight"))


@query("a18_stored_seabed", "raw_file:s ping_idx:i seabed_idx:i", LINE, STENCIL)
def stored_seabed(v: Survey) -> DataFrame:
    """The seabed line, stored file by file: a first run over a part of the files, a second adds the others."""
    path, whole = _scratch(v, "seabed"), whole_profiles(v)
    first = whole.join(F.broadcast(v.file.filter("n_pings % 3 = 0").select("raw_file")), "raw_file", "left_semi")
    for part in (first, whole):
        jobs.store_new_files(part, path, seabed_line)
    return v.spark.read.parquet(path)
