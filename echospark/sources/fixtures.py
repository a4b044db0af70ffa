"""Survey tables derived by Spark from the driver's tables (see FIXTURES.md), and the same definitions for DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocks import BlockTable, with_halo
from ..operators.objects import written_in_buckets

N_RANGE = 64
RANGE_STEP = 0.5
FREQ_KHZ = (18, 38, 120, 200)
CATEGORIES = (1, 27, 6009)


#: Pings of a bucket of the profile table, at most on average.
BUCKET = 1 << 16

#: Pings of a block of the profile table in blocks, and how many pings ahead of and behind a block stand with it.
BLOCK, HALO = 512, 32

#: Ingested profile tables by application and table folder.
_CUBES: dict[tuple[str, str], DataFrame] = {}
_BLOCKS: dict[tuple[str, str], BlockTable] = {}


class Survey:
    """The tables of one survey set: ping, sv, seabed, school, labels, annotation, pred, transect, ext_mask."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ping(self) -> DataFrame:
        e = F.col("event_id")
        day = F.date_format("ts", "yyyy-MM-dd")
        order = Window.partitionBy("raw_file").orderBy("e")
        return (
            self.table("events")
            .select(
                e.alias("e"),
                day.alias("raw_file"),
                (2007 + F.dayofmonth("ts") % 12).alias("survey"),
                F.col("ts").alias("ping_time"),
                (((e * 7) % 11 - 5) * 0.6).alias("heave_m"),
                (55 + (e % 997) / 1000.0).alias("lat"),
                (3 + (e % 499) / 1000.0).alias("lon"),
                F.lit(5.0).alias("transducer_depth_m"),
            )
            .withColumn("ping_idx", (F.row_number().over(order) - 1).cast("int"))
        )

    @cached_property
    def file(self) -> DataFrame:
        return self.ping.groupBy("survey", "raw_file").agg(F.count("*").cast("int").alias("n_pings")).withColumn("n_range", F.lit(N_RANGE))

    @cached_property
    def seabed(self) -> DataFrame:
        return self.ping.select("survey", "raw_file", "ping_idx", (40 + F.expr("e div 8") % 12).cast("int").alias("seabed_idx"))

    @cached_property
    def sv(self) -> DataFrame:
        """One row per ping and frequency with the whole profile, ingested once for each Spark application and table folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _CUBES:
            n = self._buckets()
            dealt = self.ping.repartition(n, "raw_file", "ping_idx")
            _CUBES[key] = written_in_buckets(self._cube(dealt, "survey", "raw_file", "ping_idx", "ping_time", "e"), ["raw_file", "ping_idx"], n)
        return _CUBES[key]

    @cached_property
    def blocks(self) -> BlockTable:
        """sv in blocks of pings with halo rows, ingested like sv: for queries of windows of pings, which need no other profile table."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _BLOCKS:
            n = self._buckets()
            order = Window.partitionBy("raw_file").orderBy("e")
            pings = self.ping.withColumn("end", F.lag("e").over(order).isNull() | F.lead("e").over(order).isNull())
            dealt = with_halo(pings, "ping_idx", HALO, HALO, BLOCK).withColumn("block", F.col("block").cast("int")).repartition(n, "raw_file", "block")
            rows = written_in_buckets(self._cube(dealt, "survey", "raw_file", "block", "own", "end", "ping_idx"), ["raw_file", "block"], n)
            _BLOCKS[key] = BlockTable(rows, BLOCK, HALO, n)
        return _BLOCKS[key]

    def beside_profiles(self, rows: DataFrame) -> DataFrame:
        """rows(raw_file, ping_idx, ...) written in the buckets of sv, for what a query joins to profiles more than once."""
        n, keys = self._buckets(), ["raw_file", "ping_idx"]
        return written_in_buckets(rows.repartition(n, *keys), keys, n)

    def _buckets(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.table("events").count() // BUCKET + 1)

    def _cube(self, dealt: DataFrame, *columns: str) -> DataFrame:
        """Pings are dealt into buckets before they become profiles, so no profile is shuffled."""
        seabed = 40 + F.expr("e div 8") % 12
        freqs = F.explode(F.array(*map(F.lit, FREQ_KHZ)))
        rows = dealt.select(*{*columns, "e"}, seabed.alias("b"), freqs.alias("f"))
        cell = """transform(sequence(0, 63), r -> if((e + r + f) % 211 = 0, double('NaN'),
            ((e * 31 + f * 7 + r * r * 13) % 997 + 1 + if(r = b, 100000, if(r > b, 50000, 0))) * double(1e-8)))"""
        return rows.select(*columns, (F.col("f") * 1000).alias("freq_hz"), F.expr(cell).alias("sv"))

    @cached_property
    def school(self) -> DataFrame:
        k = F.expr("e div 25")
        return self.ping.filter("e % 25 = 0").select(
            "survey",
            "raw_file",
            F.col("e").alias("object_id"),
            F.col("ping_idx").alias("x0"),
            (F.col("ping_idx") + F.when(k % 17 == 0, -1).otherwise(3 + k % 9)).cast("int").alias("x1"),
            (5 + k % 20).cast("int").alias("y0"),
            (5 + k % 20 + 2 + k % 6).cast("int").alias("y1"),
            F.element_at(F.array(*map(F.lit, (27, 1, 6009, -1))), (k % 4 + 1).cast("int")).alias("category"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        """Valid school boxes by ping: raw_file, ping_idx, boxes[(category, lo, hi)]."""
        each = self.school.filter("x0 <= x1 and category <> -1").select("raw_file", F.explode(F.sequence("x0", "x1")).alias("ping_idx"), "category", F.col("y0").alias("lo"), F.col("y1").alias("hi"))
        return each.groupBy("raw_file", "ping_idx").agg(F.collect_list(F.struct("category", "lo", "hi")).alias("boxes"))

    @cached_property
    def annotation(self) -> DataFrame:
        """One mask per ping and category."""
        cats = F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category")
        rows = self.ping.select("raw_file", "ping_idx", cats).join(self.boxes, ["raw_file", "ping_idx"], "left")
        mask = """if(exists(boxes, b -> b.category = category),
            transform(sequence(0, 63), r -> int(exists(boxes, b -> b.category = category and b.lo <= r and r <= b.hi))), array_repeat(0, 64))"""
        return rows.select("raw_file", "ping_idx", "category", F.expr(mask).alias("mask"))

    @cached_property
    def pred(self) -> DataFrame:
        p = "transform(sequence(0, 63), r -> ((e * 17 + r * 29) % 1000) / double(1000))"
        return self.ping.select("survey", "raw_file", "ping_idx", F.expr(p).alias("p_sandeel")).withColumn("p_other", F.transform("p_sandeel", lambda x: (1 - x) / 2))

    @cached_property
    def transect(self) -> DataFrame:
        return self.ping.filter("e % 50 = 0").select("raw_file", F.col("ping_time").alias("start_time"), (F.col("ping_time") + F.expr("interval 20 minutes")).alias("stop_time"))

    @cached_property
    def ext_mask(self) -> DataFrame:
        low = 5 + (F.col("e") % 7) * 0.5
        return self.ping.filter("e % 10 = 3").select("raw_file", F.col("e").alias("ping_number"), (F.col("ping_time") - F.expr("interval 30 seconds")).alias("time"), low.alias("min_m"), (low + 3).alias("max_m"))


#: The same definitions in long form for DuckDB.
DUCK = """
ping AS (SELECT event_id AS e, strftime(ts, '%Y-%m-%d') AS raw_file, 2007 + day(ts) % 12 AS survey, ts AS ping_time,
  ((event_id * 7) % 11 - 5) * 0.6::DOUBLE AS heave_m, 55 + (event_id % 997) / 1000.0::DOUBLE AS lat, 3 + (event_id % 499) / 1000.0::DOUBLE AS lon,
  row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS ping_idx, 40 + (event_id // 8) % 12 AS b FROM events),
file AS (SELECT survey, raw_file, count(*) AS n_pings FROM ping GROUP BY ALL),
freq AS (SELECT unnest([18, 38, 120, 200]) AS f), rng AS (SELECT unnest(range(64)) AS r),
sv AS (SELECT raw_file, ping_idx, e, b, f, r, CASE WHEN (e + r + f) % 211 = 0 THEN 'NaN'::DOUBLE ELSE
  ((e * 31 + f * 7 + r * r * 13) % 997 + 1 + CASE WHEN r = b THEN 100000 WHEN r > b THEN 50000 ELSE 0 END) * 1e-8::DOUBLE END AS v FROM ping, freq, rng),
school AS (SELECT survey, raw_file, e AS object_id, ping_idx AS x0, ping_idx + CASE WHEN (e // 25) % 17 = 0 THEN -1 ELSE 3 + (e // 25) % 9 END AS x1,
  5 + (e // 25) % 20 AS y0, 5 + (e // 25) % 20 + 2 + (e // 25) % 6 AS y1, [27, 1, 6009, -1][((e // 25) % 4 + 1)::INT] AS category FROM ping WHERE e % 25 = 0),
lay AS (SELECT DISTINCT p.raw_file, p.ping_idx, r, category FROM school s JOIN ping p ON p.raw_file = s.raw_file AND p.ping_idx BETWEEN x0 AND x1
  JOIN rng ON r BETWEEN y0 AND y1 WHERE x0 <= x1 AND category <> -1),
label AS (SELECT p.raw_file, p.ping_idx, p.b, p.e, rng.r, coalesce(l.label, 0) AS label FROM ping p CROSS JOIN rng LEFT JOIN
  (SELECT raw_file, ping_idx, r, max(category) AS label FROM lay GROUP BY ALL) l ON l.raw_file = p.raw_file AND l.ping_idx = p.ping_idx AND l.r = rng.r),
pred AS (SELECT survey, raw_file, ping_idx, r, ((e * 17 + r * 29) % 1000) / 1000.0::DOUBLE AS p FROM ping, rng),
transect AS (SELECT raw_file, ping_time AS t0, ping_time + INTERVAL 20 MINUTE AS t1 FROM ping WHERE e % 50 = 0),
ext_mask AS (SELECT raw_file, e AS ping_number, ping_time - INTERVAL 30 SECOND AS time, 5 + (e % 7) * 0.5::DOUBLE AS min_m, 8 + (e % 7) * 0.5::DOUBLE AS max_m FROM ping WHERE e % 10 = 3)
"""
