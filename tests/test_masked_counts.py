"""Region and trace evaluation on columns of patches against the same on cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.functions import acoustic as A
from echospark.operators import evaluation as E
from echospark.operators import labels as L

H = 8


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(5)
    codes = [0, 0, 1, 2, A.SEABED, A.OVERLAP, A.BORDER, A.IGNORE, A.OTHER]
    columns = [(m, f, p, int(rng.integers(-4, 9)), rng.choice(codes, H).tolist()) for m in ("region", "trace") for f in "ab" for p in range(-1, 21)]
    objects = [("a", 3, 5, 2, 4), ("a", 4, 9, 3, 8), ("b", 12, 12, 0, 1)]
    scores = [(2007 + (f == "b"), f, p, None if p == 7 else [None if r == 3 and p % 5 == 0 else float(x) for r, x in enumerate(rng.uniform(0, 1, 10 + p % 3).round(2))]) for f in "ab" for p in range(20)]
    return (
        spark.createDataFrame(columns, "mode string, raw_file string, ping_idx int, top int, labels array<short>"),
        spark.createDataFrame(objects, "raw_file string, x0 int, x1 int, y0 int, y1 int"),
        spark.createDataFrame(scores, "survey int, raw_file string, ping_idx int, p array<double>"),
    )


def test_counts_of_columns_are_those_of_cells(spark, case):
    columns, objects, scores = case
    half = scores.withColumn("p", E.half_precision_profile("p"))
    got = {tuple(r) for r in E.masked_counts(columns, L.object_spans(objects, 2), L.object_pings(objects, 2), half, H).collect()}
    cells = columns.select("mode", "raw_file", "ping_idx", F.posexplode("labels").alias("y", "label"), "top").select("mode", "raw_file", "ping_idx", (F.col("top") + F.col("y")).alias("r"), F.col("label").cast("int").alias("label"))
    want = set()
    for mode in ("region", "trace"):
        for compat in (False, True):
            coded = L.region_masked(cells.filter(F.col("mode") == mode).drop("mode"), objects, 2, mode == "trace", compat=compat)
            exact = scores.select("survey", "raw_file", "ping_idx", F.transform("p", A.half_precision).alias("p"))
            rows = coded.join(exact, ["raw_file", "ping_idx"]).withColumn("score", F.when(F.col("r") >= 0, F.get("p", F.col("r")))).filter("score is not null")
            counts = E.valid_cells(rows).groupBy("survey", "score").agg(F.sum((F.col("label") == 1).cast("long")).alias("p"), F.count("*").alias("n"))
            want |= {(r.survey, mode, compat, r.score, r.p, r.n) for r in counts.collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("trace", [False, True])
def test_exploded_boxes_are_not_broadcast(case, trace):
    columns, objects, _ = case
    cells = columns.select("raw_file", "ping_idx", F.lit(1).alias("r"), F.lit(1).alias("label"))
    maps = columns.select("raw_file", "ping_idx", "labels")
    for rows in (cells, maps):
        plan = L.region_masked(rows, objects.limit(3), 2, trace)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
