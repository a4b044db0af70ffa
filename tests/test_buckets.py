"""As-of joins in buckets, tiles by arithmetic and merged spans against serial versions."""

import bisect
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.operators import joins, labels, slices

START = dt.datetime(2020, 1, 1)
at = lambda s: START + dt.timedelta(seconds=float(s))


@pytest.mark.parametrize("width", [7.0, 60.0, 1e6])
def test_neighbours_in_time(spark, width):
    rng = np.random.default_rng(3)
    pings, queries = {}, []
    for name in ("a", "b"):
        times = np.sort(rng.choice(600, 80))  # with repeated times
        times[40:] += 500  # and a gap of many buckets
        pings[name] = times.tolist()
        queries += [(name, len(queries) + i, float(t)) for i, t in enumerate(np.r_[rng.uniform(-50, 1200, 60), rng.choice(times, 20)].round(1))]
    queries.append(("c", 10_000, 5.0))
    p = spark.createDataFrame([(n, i, at(t)) for n, ts in pings.items() for i, t in enumerate(ts)], "raw_file string, ping_idx int, ping_time timestamp_ntz")
    q = spark.createDataFrame([(n, i, at(t)) for n, i, t in queries], "raw_file string, query_id long, time timestamp_ntz").repartition(3)
    near = {r.query_id: r.ping_idx for r in joins.nearest_in_time(q, p, width=width).collect()}
    ahead = {r.query_id: r.ping_idx for r in joins.first_at_or_after(q, p, width=width).collect()}
    values = p.select("raw_file", F.col("ping_time").alias("t"), (F.col("ping_idx") * 2.0).alias("v")).dropDuplicates(["raw_file", "t"])
    kept = {(r.raw_file, (r.t - START).total_seconds()): r.v for r in values.collect()}
    between = {r.query_id: r.v for r in joins.interpolated_in_time(q, spark.createDataFrame([(n, at(t), v) for (n, t), v in kept.items()], "raw_file string, t timestamp_ntz, v double"), width=width).collect()}
    for name, i, t in queries:
        ts = pings.get(name, [])
        assert near[i] == (min(range(len(ts)), key=lambda k: (abs(ts[k] - t), ts[k], k)) if ts else None)
        k = bisect.bisect_left(ts, t)
        assert ahead.get(i, -1) == (k if ts and ts[0] <= t and k < len(ts) else -1)
        own = sorted((x, v) for (n, x), v in kept.items() if n == name)
        if not own or not own[0][0] <= t <= own[-1][0]:
            assert between[i] is None
        else:
            assert between[i] == pytest.approx(float(np.interp(t, *zip(*own, strict=True))), abs=1e-6)


def test_a_long_file_is_many_groups(spark):
    p = spark.range(20_000).select(F.lit("f").alias("raw_file"), F.col("id").cast("int").alias("ping_idx"), F.timestamp_seconds(F.col("id") + 1_600_000_000).alias("ping_time"))
    seen = joins.around_in_time(p.select("raw_file", F.col("ping_idx").alias("query_id"), F.col("ping_time").alias("time")), joins._points(p, "raw_file"), "raw_file", 60.0)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") >= 4 and "hashpartitioning(raw_file" in plan and "__b" in plan
    assert seen.filter("before.value <> query_id or after.value <> query_id").count() == 0


def test_tiles_nearest_to_edges(spark):
    rng = np.random.default_rng(5)
    files = spark.createDataFrame([("a", 300, 90), ("b", 10, 8)], "raw_file string, n_pings int, n_range int")
    bottom = spark.createDataFrame([("a", 0, 80), ("b", 0, 5)], "raw_file string, ping_idx int, seabed_idx int")
    grid = slices.tiles(files, bottom, 32, 4)
    boxes = [(f, i, *sorted(rng.integers(0, n, 2).tolist()), *sorted(rng.integers(0, 90, 2).tolist())) for i, (f, n) in enumerate([("a", 300)] * 40 + [("b", 10)] * 3)]
    boxes += [("a", 99, 23, 23, 11, 35)]  # midway between two centres
    objects = spark.createDataFrame(boxes, "raw_file string, object_id int, x0 int, x1 int, y0 int, y1 int")
    axes = {}
    for r in grid.collect():
        axes.setdefault(r.raw_file, (set(), set()))
        axes[r.raw_file][0].add(r.cx)
        axes[r.raw_file][1].add(r.cy)
    near = lambda axis, v: min(axis, key=lambda c: (abs(c - v), c))
    for trace in (False, True):
        want = set()
        for f, _, x0, x1, y0, y1 in boxes:
            xs, ys = axes[f]
            want |= {(f, near(xs, x), y) for x in (x0, x1) for y in (ys if trace else {near(ys, y0), near(ys, y1)})}
        assert {(r.raw_file, r.cx, r.cy) for r in slices.tiles_at_objects(grid, objects, trace).collect()} == want


def test_spans_are_merged(spark):
    rng = np.random.default_rng(6)
    boxes = [("f", int(x), int(x + rng.integers(0, 9)), int(y), int(y + rng.integers(0, 9))) for x, y in zip(rng.integers(0, 40, 60), rng.integers(0, 60, 60), strict=True)]
    objects = spark.createDataFrame(boxes, "raw_file string, x0 int, x1 int, y0 int, y1 int")
    cells = spark.range(50 * 80).select(F.lit("f").alias("raw_file"), (F.col("id") % 50).cast("int").alias("ping_idx"), F.floor(F.col("id") / 50).cast("int").alias("r"), F.lit(5).alias("label"))
    inside = lambda p, r, trace: any(x0 - 2 <= p < x1 + 2 and (trace or y0 - 2 <= r < y1 + 2) for _, x0, x1, y0, y1 in boxes)
    for trace in (False, True):
        for compat, code in ((False, -100), (True, -1)):
            got = {(c.ping_idx, c.r): c.label for c in labels.region_masked(cells, objects, 2, trace, compat=compat).collect()}
            assert got == {(p, r): 5 if inside(p, r, trace) else code for p in range(50) for r in range(80)}
    for row in labels.object_spans(objects, 2).collect():
        assert all(a["hi"] < b["lo"] for a, b in zip(row.spans, row.spans[1:], strict=False))
