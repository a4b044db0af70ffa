"""Plans and results of joins that small tables hide: explosions, equal positions, long files."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.operators import joins
from echospark.plans import queries as Q

SF = "/root/testdata/sf0.001"
Q.load()


def test_exploded_cells_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in Q.QUERIES["d12_polygons"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_pings_meet_polygons_as_cells_do(spark):
    shapes = [("f", 1, 27, [0.0, 6.0, 3.5], [2.0, 4.0, 9.5]), ("f", 2, 1, [2.0, 5.0, 5.0, 2.0], [-3.0, -3.0, 3.0, 3.0]), ("f", 3, 6009, [4.0, 9.0, 7.0], [8.0, 30.0, 14.0])]
    polygons = spark.createDataFrame(shapes, "raw_file string, polygon_id int, category int, xs array<double>, ys array<double>")
    pings = spark.range(10).select(F.lit("f").alias("raw_file"), F.col("id").cast("int").alias("ping_idx"))
    cells = pings.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(15))))
    want = sorted(joins.cells_in_polygons(polygons, cells).collect())
    assert len(want) > 30 and sorted(joins.cells_in_polygons(polygons, pings, 16).collect()) == want


def test_crowded_positions_form_few_pairs(spark):
    rng = np.random.default_rng(8)
    pings = [(i, float(x) / 1000, float(y) / 1000) for i, (x, y) in enumerate(rng.integers(0, 40, (4000, 2)))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.01, 0.05, (60, 2)))]
    table = lambda rows, key: spark.createDataFrame(rows, f"{key} int, lat double, lon double")
    places = table(pings, "ping_id").select(F.col("lat").alias("plat"), F.col("lon").alias("plon")).distinct()
    assert joins._uncrowded(places, 0.02) < 0.005
    got = {r.point_id: r.ping_id for r in joins.nearest_position(table(points, "point_id"), table(pings, "ping_id"), 0.02).collect()}
    assert got == {i: min(pings, key=lambda p: ((p[1] - x) ** 2 + (p[2] - y) ** 2, p[0]))[0] for i, x, y in points}


def test_patches_of_crowded_blocks_at_their_borders(spark, monkeypatch):
    from echospark.functions import acoustic as A
    from echospark.plans import patches as P

    monkeypatch.setattr(P, "MOST", 3)
    n, h, r = 600, 12, P.Recipe((38000,), 6, 8)
    pings = spark.range(n).select(F.lit("f").alias("raw_file"), F.col("id").cast("int").alias("ping_idx"))
    sv = pings.select("*", F.lit(38000).alias("freq_hz"), F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda k: (F.col("ping_idx") * h + k) * F.lit(1e-7)).alias("sv"))
    labels = pings.withColumn("labels", F.array_repeat(F.lit(0), h))
    bottom, times = pings.withColumn("seabed_idx", F.lit(9)), pings.withColumn("ping_time", F.timestamp_seconds(F.col("ping_idx")))
    centres = [(i, 1 + i % 10, x) for i, x in enumerate([-30, -3, 0, 250, 251, 252, 253, 254, 255, 256, 257, 258, 259, 260, 511, 512, 598, 601, 640])]
    patches = spark.createDataFrame([("f", i, i, cy, cx) for i, cy, cx in centres] + [("gone", 99, 99, 3, 3)], "raw_file string, patch_id int, key long, cy int, cx int")
    made = P.patch_set(patches, r, sv, labels, bottom, times)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(raw_file" in plan and "__b" in plan and "patch_id" not in plan.split("FlatMapGroupsInArrow")[1].split("\n")[0].split("[")[1].split("]")[0]
    got = {x.patch_id: x for x in made.collect()}
    assert len(got) == len(centres) + 1 and set(got[99].labels) == {A.IGNORE}
    for i, cy, cx in centres:
        q, p = np.mgrid[cy - 3 + 1 : cy - 3 + 1 + 6, cx - 4 + 1 : cx - 4 + 1 + 8]
        inside = (p >= 0) & (p < n) & (q >= 0) & (q < h)
        db = np.clip(10 * np.log10(np.where(inside, (p * h + q) * 1e-7, 0) + 1e-10), -75, 0)
        np.testing.assert_allclose(got[i].data[0], db.ravel(), rtol=1e-5)
        assert got[i].labels == np.where(inside, 0, A.IGNORE).ravel().tolist()


@pytest.fixture(scope="module")
def long_file(spark, tmp_path_factory):
    """60,000 pings of one file; the mask's ping 503 and its neighbour have one time."""
    path = str(tmp_path_factory.mktemp("long"))
    e = F.col("id")
    micros = F.lit(1_704_067_200_000_000) + F.when(e == 504, 503).otherwise(e) * 1_400_000
    spark.range(60_000).select(e.alias("event_id"), F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.mark.parametrize("name", ["b11_b13_tiles", "b12_region_tiles", "b12_trace_tiles", "b14_split_ranges", "e17_tile_counts", "d14_work_mask_cells"])
def test_sql_holds_for_long_files_and_equal_times(spark, long_file, name):
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{long_file}/events.parquet/*.parquet'")
    want = sorted(con.sql(Q.ORACLE[name]).fetchall())
    assert len(want) > 800 and sorted(map(tuple, Q.QUERIES[name](spark, long_file).collect())) == want


def test_chains_read_profiles_once(spark):
    for name in ("g5_training_chain", "g5_evaluation_chain", "m6_patch_data"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert sum("Scan parquet" in line and "sv#" in line for line in plan.splitlines()) <= 1, name


def test_patches_are_made_from_their_own_files_and_summed_as_arrays(spark):
    from echospark.plans import patches as P

    pings = spark.range(6).select(F.concat(F.lit("f"), F.col("id") % 2).alias("raw_file"), F.floor(F.col("id") / 2).cast("int").alias("ping_idx"))
    sv = pings.select("*", F.lit(38000).alias("freq_hz"), F.array_repeat(F.lit(1e-7), 4).alias("sv"))
    one = spark.createDataFrame([("f0", 1, 1, 1, 1)], "raw_file string, patch_id int, key long, cy int, cx int")
    made = P.patch_set(one, P.Recipe((38000,), 2, 2), sv, pings.withColumn("labels", F.array_repeat(F.lit(0), 4)), pings.withColumn("seabed_idx", F.lit(2)), pings.withColumn("ping_time", F.timestamp_seconds("ping_idx")))
    assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 1
    plan = Q.QUERIES["m6_training_patches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode(cells" not in plan


def test_splits_of_a_file_of_a_million_pings(spark):
    from echospark.operators import slices

    n = 1_200_000
    got = slices.split_ranges(spark.createDataFrame([(0, n)], "start int, stop int"), 100).orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in got] == [(100 * k, 100 * k + 100) for k in range(n // 100)]
