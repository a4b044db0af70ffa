"""Every survey query against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echospark.plans import queries as Q
from echospark.plans.jobs import store_new_files
from echospark.sources.fixtures import Survey
from echospark.sources.tables import stored_table

SF = "/root/testdata/sf0.001"
Q.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_duckdb(spark, duck, name):
    got, want = ordered(Q.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(Q.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1.5e-6)


def test_no_nested_loop_joins(spark):
    for name in ("d0_d4_valid_pings", "d9_box_overlap", "d12_polygons", "g4_region_masked", "e15_regridded_pings", "h2_background"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_whole_queries_take_every_ping(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    out = Q.QUERIES["d11_aligned_channels"](spark, sf)
    last = {r.raw_file: r.k for r in out.groupBy("raw_file").agg(F.max("k").alias("k")).collect()}
    pings = {r.raw_file: r.k for r in Survey(spark, sf).ping.groupBy("raw_file").agg(F.max("ping_idx").alias("k")).collect()}
    assert max(pings.values()) > 100 and last.keys() == pings.keys() and all(last[f] >= k for f, k in pings.items())


def test_stored_files_are_not_worked_on_again(spark, tmp_path):
    rows = spark.range(12).select((F.col("id") % 3).cast("string").alias("raw_file"), F.col("id").alias("ping_idx"))
    path = str(tmp_path / "store")
    assert stored_table(spark, path) is None
    store_new_files(rows.filter("raw_file = '1'"), path, lambda r: r.withColumn("run", F.lit(1)))
    store_new_files(rows, path, lambda r: r.withColumn("run", F.lit(2)))
    store_new_files(rows, path, lambda r: r.withColumn("run", F.lit(3)))
    got = {(r.raw_file, r.run): r.n for r in spark.read.parquet(path).groupBy("raw_file", "run").agg(F.count("*").alias("n")).collect()}
    assert got == {("0", 2): 4, ("1", 1): 4, ("2", 2): 4}
