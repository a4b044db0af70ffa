"""Cell-wise prediction of whole files against a loop over cells, and what it shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.functions import acoustic as A
from echospark.operators.joins import NOT_RETURNED
from echospark.plans import jobs
from echospark.plans import queries as Q

SF = "/root/testdata/sf0.001"
Q.load()
FREQS = [38000, 120000]


def _model():
    """A local function travels to the workers by value."""
    return lambda x: np.column_stack([np.zeros(len(x)), x[:, 0] / 20, x[:, 1] / 30])


model = _model()


@pytest.mark.parametrize("cells", [1 << 20, 40])
def test_profiles_of_scores_against_a_loop_over_cells(spark, monkeypatch, cells):
    monkeypatch.setattr(jobs, "CELLS", cells)
    rng = np.random.default_rng(3)
    n, h = 19, 24
    sv = {(f, p, k): 10.0 ** rng.uniform(-9, -2, h if p % 4 else h - 5 + 10 * (p % 8 == 0)) for f in "ab" for p in range(n) for k in FREQS if (p, k) != (6, 38000)}
    sv["a", 3, 38000][5] = np.nan
    marks = {(f, p): rng.choice([0, 0, 0, 1, 27, A.IGNORE, A.SEABED], h + 2 * (p % 3 == 0)).tolist() for f in "ab" for p in range(n) if p != 11}
    deep = {"a": 6, "b": 40}
    files = spark.createDataFrame([(f, n, h) for f in "ab"] + [("none", 0, h)], "raw_file string, n_pings int, n_range int")
    profiles = spark.createDataFrame([(f, p, k, v.tolist()) for (f, p, k), v in sv.items()], "raw_file string, ping_idx int, freq_hz int, sv array<double>")
    labels = spark.createDataFrame([(f, p, v) for (f, p), v in marks.items()], "raw_file string, ping_idx int, labels array<int>")
    bottom = spark.createDataFrame([(f, p, d) for f, d in deep.items() for p in range(n)], "raw_file string, ping_idx int, seabed_idx int")
    monkeypatch.setattr(jobs.slices, "tiles", lambda *a, tiles=jobs.slices.tiles: tiles(*a, margin=2))
    got = {(r.raw_file, r.ping_idx): r for r in jobs.predict_survey(files, profiles, labels, bottom, FREQS, model, 12, 2, h).collect()}
    assert set(got) == {(f, p) for f in "ab" for p in range(n)}
    for (f, p), row in got.items():
        # interiors of 8 bins from bin 0 on, down to the deepest seabed and 2 bins more
        reach = 8 * -(-min(h, deep[f] + 2) // 8)
        label = marks.get((f, p), [])
        keep = [r for r in range(len(label)) if r < reach and label[r] not in NOT_RETURNED]
        size = max(h, keep[-1] + 1 if keep else 0)
        want = np.zeros((size, 3))
        for r in keep:
            v = [sv[f, p, k][r] if (f, p, k) in sv and r < len(sv[f, p, k]) else 0.0 for k in FREQS]
            x = np.clip(10 * np.log10(np.nan_to_num(np.array([v])) + 1e-10), -75, 0)
            e = np.exp(model(x)[0])
            want[r] = e / e.sum()
        np.testing.assert_allclose(row.p_sandeel, want[:, 1], rtol=1e-12)
        np.testing.assert_allclose(row.p_other, want[:, 2], rtol=1e-12)


def test_profiles_and_cells_are_not_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.QUERIES["m2_tiled_prediction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "sv#" in line)
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above, at = [*above, line], depth(line)
    # between the stored profiles and the scores
    scored = next(i for i, line in enumerate(above) if "MapInArrow" in line)
    assert scored and not any("Exchange" in line for line in above[:scored]) and "explode(arrays_zip" not in plan


def test_equal_cells_are_one_row_and_profiles_are_scored_as_cells(spark):
    rng = np.random.default_rng(8)
    rows = [("f", p, *([float(x) for x in rng.choice([1e-7, 3e-6, np.nan, 1e-4], 6 + p % 2)] for _ in FREQS), rng.choice([0, 1, 27, 6009], 7).tolist()) for p in range(60)]
    pings = spark.createDataFrame(rows, "raw_file string, ping_idx int, a array<double>, b array<double>, labels array<int>")
    cells = pings.select("raw_file", "ping_idx", F.posexplode(F.arrays_zip("a", "b", "labels")).alias("r", "c"))
    db = lambda n: A.db_clipped(A.without_non_finite(F.col(f"c.{n}"))).alias(n)
    cells = cells.select("raw_file", "ping_idx", "r", A.species_class(F.col("c.labels")).alias("label"), db("a"), db("b"))
    equal = jobs.equal_cells(cells, ["a", "b"])
    assert equal.count() <= 3 * 4 * 4 and equal.agg(F.sum("n")).first()[0] == cells.filter("label between 0 and 2").count()
    # the fit of weighted cells, one by one
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    from echospark.operators.evaluation import CLASS_WEIGHTS

    weights = F.get(F.array(*map(F.lit, CLASS_WEIGHTS)), F.col("label"))
    each = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(cells.filter("label between 0 and 2").withColumn("weight", weights))
    want = LogisticRegression(labelCol="label", weightCol="weight", regParam=0.01, maxIter=200, tol=1e-10, family="multinomial").fit(each)
    got = jobs.train_cells(cells, ["a", "b"], rounds=200)
    np.testing.assert_allclose(got.coefficientMatrix.toArray(), want.coefficientMatrix.toArray(), rtol=1e-3, atol=1e-5)
    np.testing.assert_allclose(got.interceptVector.toArray(), want.interceptVector.toArray(), rtol=1e-3, atol=1e-4)
    w, b = got.coefficientMatrix.toArray(), got.interceptVector.toArray()
    linear = lambda x: x @ w.T + b
    scores = {(r.ping_idx, r.r): (r.p0, r.p1, r.p2) for r in jobs.score_cells(cells, ["a", "b"], linear).collect()}
    profiles = {(r.ping_idx, k): p for r in jobs.score_profiles(pings, ["a", "b"], linear).collect() for k, p in enumerate(zip(r.p0, r.p1, r.p2, strict=True))}
    assert set(profiles) == set(scores) and len(scores) == 60 * 7
    for k, p in scores.items():
        np.testing.assert_allclose(profiles[k], p, rtol=1e-9)
