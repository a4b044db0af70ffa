"""Hand-computed cases and properties of survey operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.functions import acoustic as A
from echospark.operators import evaluation, joins, labels, objects, seabed
from echospark.sources import tables


def test_half_precision_is_numpys(spark):
    values = [0.0, 2.0**-30, *[2.0**-k for k in range(15)], *[2.0**-k * 1.3333 for k in range(15)], *np.random.default_rng(1).random(500).tolist()]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", A.half_precision(F.col("v")).alias("h")).collect()
    assert all(float(np.float16(r.v)) == r.h for r in rows)


def test_decibels_at_and_below_zero(spark):
    row = spark.range(1).select(A.db(F.lit(-1.0)).alias("a"), A.db(F.lit(-1e-10)).alias("b"), A.db_clipped(F.lit(float("nan"))).alias("c")).first()
    assert np.isnan(row.a) and row.b == -np.inf and np.isnan(row.c)


def test_components_of_a_small_map(spark):
    grid = [[1, 1, 0, 0], [0, 1, 0, 27], [27, 0, 0, 27], [27, 27, 1, 0]]
    df = spark.createDataFrame([("f", i, row) for i, row in enumerate(grid)], "raw_file string, ping_idx int, labels array<int>")
    got = sorted((r.category, r.n_pixels, r.x0, r.x1, r.y0, r.y1, r.labeled_as_segmentation) for r in objects.label_objects(df).collect())
    assert got == [(1, 1, 3, 3, 2, 2, False), (1, 3, 0, 1, 0, 1, True), (27, 2, 1, 2, 3, 3, False), (27, 3, 2, 3, 0, 1, True)]


def test_closing_fills_a_hole_and_keeps_single_cells(spark):
    cells = [("f", 5 + dx, 5 + dy) for dx in range(5) for dy in range(5) if (dx, dy) != (2, 2)] + [("f", 30, 30)]
    df = spark.createDataFrame(cells, "raw_file string, ping_idx int, r int")
    box = spark.createDataFrame([("f", 0, 40, 0, 40)], "raw_file string, x0 int, x1 int, y0 int, y1 int")
    got = {(r.ping_idx, r.r) for r in labels.closed_cells(df, box, ["raw_file"]).collect()}
    assert (7, 7) in got and (30, 30) in got and {(p, r) for _, p, r in cells} <= got
    assert len(labels.DISC) == 37


def _patch(rows):
    """Cells of one patch of width 9 from rows of (label, v)."""
    return [("f", 1, x, y, x, y, label, v, 6) for y, row in enumerate(rows) for x, (label, v) in enumerate(row)]


_CELLS = "raw_file string, patch_id int, x int, y int, ping_idx int, r int, label int, v double, seabed_idx int"


def test_chains_of_a_patch(spark):
    strong, weak = (27, 1e-6), (27, 1e-9)
    rows = [[(0, 1e-6)] * 9 for _ in range(20)]
    for y in range(6, 13):
        rows[y] = [(0, 1e-6), strong, strong, strong, strong, strong, strong, weak, (6009, 1e-6)]
    rows[9][4] = weak
    rows[0] = [(-100, 0.0)] * 9
    df = spark.createDataFrame(_patch(rows), _CELLS)
    keys = ["raw_file", "patch_id"]
    got = {(c.x, c.y): c.label for c in labels.evaluation_chain(df, keys, 20, 9, 0).collect()}
    assert len(got) == 180
    assert got[4, 9] == 1, "a hole of the seed is closed"
    assert got[7, 9] == A.BORDER and got[8, 9] == A.OTHER, "weak edge cells go, another species is no seed and stays"
    assert got[3, 0] == A.IGNORE and got[3, 15] == 0 and got[3, 16] == A.SEABED
    edged = {(c.x, c.y): c.label for c in labels.evaluation_chain(df, keys, 20, 9, 2).collect()}
    assert edged[0, 9] == A.OVERLAP and edged[3, 0] == A.IGNORE and edged[4, 9] == 1
    trained = {(c.x, c.y): c.label for c in labels.training_chain(df, keys).collect()}
    assert trained[4, 9] == 1 and trained[8, 9] == A.IGNORE and trained[3, 15] == 0


def test_a_patch_outside_the_data_stays_as_it_is(spark):
    df = spark.createDataFrame(_patch([[(A.IGNORE, 0.0)] * 9] * 3), _CELLS)
    assert {c.label for c in labels.refined_patches(df, ["raw_file", "patch_id"]).collect()} == {A.IGNORE}
    assert labels.refined_patches(df.limit(0), ["raw_file", "patch_id"]).count() == 0


@pytest.mark.parametrize("h,want", [(0, [1, 2, 3]), (1, [2, 3, 0]), (-1, [0, 1, 2]), (9, [0, 0, 0]), (-9, [0, 0, 0])])
def test_heave_shift(spark, h, want):
    df = spark.createDataFrame([([1, 2, 3],)], "l array<int>")
    assert df.select(seabed.heave_shifted("l", F.lit(h)).alias("x")).first().x == want


def test_precision_recall_of_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True), (0.1, False)], "score double, positive boolean")
    got = [(r.threshold, round(r.precision, 4), r.recall) for r in evaluation.precision_recall(df).orderBy(F.col("threshold").asc_nulls_last()).collect()]
    assert got == [(0.5, 0.6667, 1.0), (0.9, 0.5, 0.5), (None, 1.0, 0.0)]


def test_dense_files(spark, tmp_path):
    a = np.arange(12, dtype="<f4").reshape(3, 4)
    for folder, k in (("x", 0), ("y", 100)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "data_for_freq_18.dat").write_bytes((a + k).tobytes())
    (tmp_path / "y" / "short.dat").write_bytes(b"123")
    (tmp_path / "other.dat").write_bytes(b"12")
    rows = [("x/data_for_freq_18.dat", "a", 18000, 3, 4), ("y/data_for_freq_18.dat", "b", 18000, 3, 4), ("y/short.dat", "c", 18000, 3, 4), ("y/gone.dat", "d", 18000, 3, 4)]
    manifest = spark.createDataFrame(rows, "path string, raw_file string, freq_hz int, n_range int, n_pings int")
    dense = tables.read_dense(spark, f"file://{tmp_path}", manifest)
    got = [(r.raw_file, r.ping_idx, r.sv) for r in dense.filter("reason is null").collect()]
    assert sorted(got) == sorted([("a", p, a[:, p].tolist()) for p in range(4)] + [("b", p, (a + 100)[:, p].tolist()) for p in range(4)])
    bad = {r.source: r.reason for r in tables.quarantined(dense, manifest).collect()}
    assert bad == {"y/short.dat": "size does not fit", "other.dat": "not in the manifest", "y/gone.dat": "no file"}


def test_boxes_are_matched_greedily(spark):
    """The second of two detections falls to the next free truth; ties go to the smaller ids; random boxes against a serial version."""
    rng = random.Random(4)
    truth = [("f", rng.randrange(2), i, x, x + rng.randrange(2, 9), y, y + rng.randrange(2, 9)) for i in range(60) for x, y in [(rng.randrange(60), rng.randrange(12))]]
    found = [("f", c, 2 * i + k, x0 + rng.randrange(-1, 2), x1 + rng.randrange(2), y0, y1, rng.randrange(5) / 4) for c, i, x0, x1, y0, y1 in [t[1:] for t in truth] for k in (0, 1)]
    got = evaluation.match_boxes(
        spark.createDataFrame(truth, "raw_file string, category int, object_id long, x0 int, x1 int, y0 int, y1 int"),
        spark.createDataFrame(found, "raw_file string, category int, det_id long, bx0 int, bx1 int, by0 int, by1 int, score double"),
        16,
        0.4,
    )
    free, want = {t[2]: t for t in truth}, {}
    for _, c, d, bx0, bx1, by0, by1, _ in sorted(found, key=lambda r: (-r[7], r[2])):
        best = (0.0, 0)
        for o, (_, tc, _, x0, x1, y0, y1) in free.items():
            w, h = min(x1, bx1) - max(x0, bx0) + 1, min(y1, by1) - max(y0, by0) + 1
            if tc == c and w > 0 and h > 0:
                iou = w * h / ((x1 - x0 + 1) * (y1 - y0 + 1) + (bx1 - bx0 + 1) * (by1 - by0 + 1) - w * h)
                best = max(best, (iou, -o)) if iou >= 0.4 else best
        want[d] = best[0] or None
        if best[0]:
            del free[-best[1]]
    assert {r.det_id: r.iou for r in got.collect()} == want and sum(v is not None for v in want.values()) > 30


def test_nearest_position_at_any_distance(spark):
    rng = np.random.default_rng(5)
    pings = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.normal([60.0, -3.0], 0.3, (300, 2)))] + [(300, float("nan"), 5.0)]
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(np.r_[rng.normal([60.0, -3.0], 2.0, (40, 2)), rng.uniform(-80, 80, (20, 2))])]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, lat double, lon double")
    got = {r.point_id: r.ping_id for r in joins.nearest_position(df([*points, (99, float("nan"), 1.0)], "point_id"), df(pings, "ping_id"), 0.02).collect()}
    want = {p: min((q for q in pings if q[1] == q[1]), key=lambda q: ((q[1] - y) ** 2 + (q[2] - x) ** 2, q[0]))[0] for p, y, x in points}
    assert got == {**want, 99: None}
    assert [r.ping_id for r in joins.nearest_position(df(points[:1], "point_id"), df(pings[300:], "ping_id"), 0.02).collect()] == [None]


def test_average_precision_against_a_serial_version(spark):
    rng = random.Random(11)
    truth, found = [], []
    for i in range(90):
        f, c, x, y = rng.choice("abc"), rng.choice([1, 27, 27]), rng.randrange(120), rng.randrange(60)
        w, h = rng.randrange(2, 14), rng.randrange(2, 14)
        truth.append((f, c, i, x, x + w, y, y + h))
        for k in range(rng.randrange(3)):
            found.append((f, rng.choice([c, c, 1]), 3 * i + k, x + rng.randrange(-1, 2), x + w + rng.randrange(3), y, y + h + rng.randrange(-1, 2), rng.randrange(9) / 9))
    areas, thresholds, most = {"all": (0, 1e10), "small": (0, 60), "large": (61, 1e10)}, (0.5, 0.8), 12
    got = {
        (r.category, r.area, r.threshold): (r.n, r.ap)
        for r in evaluation.average_precision(
            spark.createDataFrame(truth, "raw_file string, category int, object_id long, x0 int, x1 int, y0 int, y1 int"),
            spark.createDataFrame(found, "raw_file string, category int, det_id long, bx0 int, bx1 int, by0 int, by1 int, score double"),
            16,
            thresholds,
            areas,
            most,
        ).collect()
    }
    area = lambda b: (b[1] - b[0] + 1) * (b[3] - b[2] + 1)
    want = {}
    for c in (1, 27):
        for name, (lo, hi) in areas.items():
            n = sum(t[1] == c and lo <= area(t[3:]) <= hi for t in truth)
            for limit in thresholds:
                marks = []
                for f in "abc":
                    free = {t[2]: t[3:] for t in truth if t[:2] == (f, c)}
                    for d in sorted((d for d in found if d[:2] == (f, c)), key=lambda d: (-d[7], d[2]))[:most]:
                        box, best = d[3:7], None
                        for o, t in free.items():
                            w, h = min(box[1], t[1]) - max(box[0], t[0]) + 1, min(box[3], t[3]) - max(box[2], t[2]) + 1
                            iou = w * h / (area(box) + area(t) - w * h) if w > 0 and h > 0 else 0
                            rank = (not lo <= area(t) <= hi, -iou, o)
                            if iou >= limit and (best is None or rank < best):
                                best = rank
                        if best:
                            del free[best[2]]
                        if not (best[0] if best else not lo <= area(box) <= hi):
                            marks.append((-d[7], d[2], best is not None))
                tp, points = 0, []
                for seen, (_, _, hit) in enumerate(sorted(marks), 1):
                    tp += hit
                    points.append((tp, tp / seen))
                want[c, name, limit] = (n, sum(max((p for t, p in points if 100 * t >= k * n), default=0) for k in range(101)) / 101)
    assert got.keys() == want.keys()
    for key, (n, ap) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(ap)
    assert 0.1 < want[27, "all", 0.5][1] < 0.99


def test_trained_cells_beat_the_class_prior(spark):
    """Weighted loss of a classifier on cells that it has not seen, against the best constant answer."""
    from echospark.plans import jobs

    rng = np.random.default_rng(9)
    y = rng.choice(3, 6000, p=[0.9, 0.06, 0.04])
    x = rng.normal(0, 1, (6000, 2)) + np.array([[0, 0], [2, 0], [0, 2]])[y]
    cells = spark.createDataFrame([(int(i % 4), int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x, strict=True))], "batch int, label int, a double, b double")
    model = jobs.train_cells(cells.filter("batch < 2"), ["a", "b"], rounds=20)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    scored = jobs.score_cells(cells.filter("batch >= 2"), ["a", "b"], lambda v: v @ weights.T + bias)
    loss = evaluation.weighted_loss(scored).first().loss
    share = np.bincount(y, minlength=3) * np.array(evaluation.CLASS_WEIGHTS)
    prior = share / share.sum()
    constant = cells.filter("batch >= 2").withColumns({f"p{k}": F.lit(float(prior[k])) for k in range(3)})
    assert loss < 0.8 * evaluation.weighted_loss(constant).first().loss
