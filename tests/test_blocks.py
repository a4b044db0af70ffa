"""Sums and ranks over ranges of rows, and the draws that look ranks up."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echospark.functions import acoustic as A
from echospark.operators import blocks, evaluation, sampling


@pytest.fixture(scope="module")
def values():
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(10**6), rng.randrange(5)) for _ in range(3000)]
    return list({r[:2]: r for r in rows}.values())


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_running_sums_and_ranks(spark, values, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(values, "k string, x long, v int")
        summed = blocks.running_sums(df, ["k"], [F.desc("x")], {"s": "v", "c": F.lit(1)}).collect()
        placed = blocks.ranked(df, ["k"], ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(summed) == len(placed) == len(values)
    want, total, count = {}, Counter(), Counter()
    for k, x, v in sorted(values, key=lambda r: -r[1]):
        total[k] += v
        count[k] += 1
        want[k, x] = (total[k], count[k])
    assert {(r.k, r.x): (r.s, r.c) for r in summed} == want
    assert {(r.k, r.x): r.rank for r in placed} == {(k, x): count[k] - c for (k, x), (_, c) in want.items()}


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, x long")
    assert blocks.ranked(df, ["k"], ["x"]).count() == 0
    assert evaluation.precision_recall(spark.createDataFrame([], "score double, positive boolean")).count() == 0


def test_every_candidate_is_drawn_alike(spark):
    pool = [("seabed", "f", i, i, i + 1, 50, 51, 0, 4) for i in range(10)] + [("school_27", "f", 1, 5, 9, 20, 22, 0, 0)]
    pool = spark.createDataFrame(pool, "sampler string, raw_file string, key long, x0 int, x1 int, y0 int, y1 int, jitter_x int, jitter_y int")
    out = sampling.drawn_centres(spark.range(4000).withColumnRenamed("id", "draw_id"), pool, 3, (("seabed", 3), ("school_27", 1), ("school_1", 1))).collect()
    assert len(out) == 4000 and {r.cy is None for r in out if r.sampler == "school_1"} == {True}
    seabed = [r for r in out if r.sampler == "seabed"]
    assert all(r.cx == r.key for r in seabed) and {r.cy for r in seabed} == set(range(48, 53))
    share = Counter(r.key for r in seabed)
    assert len(share) == 10 and all(150 < n < 350 for n in share.values())
    assert {(r.cx, r.cy) for r in out if r.sampler == "school_27"} == {(x, y) for x in range(5, 9) for y in (20, 21)}
    again = sampling.drawn_centres(spark.range(4000, numPartitions=3).withColumnRenamed("id", "draw_id"), pool.repartition(5), 3, (("seabed", 3), ("school_27", 1), ("school_1", 1))).collect()
    assert sorted(again, key=lambda r: r.draw_id) == sorted(out, key=lambda r: r.draw_id)
    assert spark.range(1).select(A.keyed_uniform(F.lit(5), 3)).first()[0] < 1
