"""Prediction runs that are killed and repeated, and the edges of splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.functions import acoustic as A
from echospark.operators import slices
from echospark.plans import prediction as P
from echospark.plans.patches import Recipe

N, H = 23, 20


@pytest.fixture(scope="module")
def survey(spark):
    rng = np.random.default_rng(6)
    names = ["a", "b", "c"]
    sv = {n: 10.0 ** rng.uniform(-9, -4, (N, H)) for n in names}
    bottom = {n: rng.integers(4, 9, N) for n in names}
    frame = lambda rows, schema: spark.createDataFrame([(n, p, *r) for n in names for p in range(N) for r in [rows(n, p)]], f"raw_file string, ping_idx int, {schema}")
    frames = (
        frame(lambda n, p: (38000, sv[n][p].tolist()), "freq_hz int, sv array<double>"),
        frame(lambda n, p: ([27 if 3 < p < 6 and r == 18 else 0 for r in range(H)],), "labels array<int>"),
        frame(lambda n, p: (int(bottom[n][p]),), "seabed_idx int"),
        frame(lambda n, p: (p,), "s int").withColumn("ping_time", F.timestamp_seconds(F.col("s") + 1_300_000_000).cast("timestamp_ntz")).drop("s"),
    )
    files = spark.createDataFrame([(n, N, H) for n in names], "raw_file string, n_pings int, n_range int")
    return sv, bottom, frames, files


RECIPE = Recipe((38000,), 12, 12, "evaluate", overlap=2, low=0.0, high=1.0)


def _model():
    """Sandeel by the mean of a 3 x 3 neighbourhood; a local function travels to the workers by value."""

    def model(x):
        wide = np.pad(x[:, 0].astype(float), ((0, 0), (1, 1), (1, 1)))
        mean = sum(wide[:, i : i + x.shape[2], j : j + x.shape[3]] for i in range(3) for j in range(3)) / 9
        return np.stack([np.zeros_like(mean), mean / 20, np.full_like(mean, -1.0)], axis=1)

    return model


model = _model()


@pytest.mark.parametrize("split", [5000, 9])
def test_whole_files_against_one_matrix(spark, survey, split):
    sv, bottom, frames, files = survey
    got = {(r.raw_file, r.ping_idx): r for r in P.predicted(files, *frames, RECIPE, model, split).collect()}
    assert len(got) == 3 * N
    pieces = max(1, -(-N // split))
    for name in sv:
        for k in range(pieces):
            lo, hi = k * N // pieces, (k + 1) * N // pieces
            db = np.clip(10 * np.log10(sv[name][lo:hi].T + 1e-10), -75, 0).astype(np.float32)
            e = np.exp(model(db[None, None])[0])
            p = e / e.sum(axis=0)
            for q in range(lo, hi):
                zero = [r >= bottom[name][q] + 10 and not (3 < q < 6 and r == 18) for r in range(H)]
                want = np.where(zero, 0, p[1, :, q - lo]).astype(np.float16)
                row = got[name, q]
                assert len(row.p_sandeel) == H
                np.testing.assert_allclose(row.p_sandeel, want.astype(float), atol=1e-3)


def test_splits_are_those_of_the_ranges(spark):
    rows = [(f"n{n}-{m}", n, m) for n in (1, 5, 99, 100, 101, 333, 1000) for m in (1, 7, 100, 5000)]
    for name, n, m in rows:
        ranges = slices.split_ranges(spark.createDataFrame([(0, n)], "start int, stop int"), m).collect() if m == 7 else None
        got = spark.range(n).select("id", *[c.alias(a) for c, a in zip(P.split_of(F.col("id"), F.lit(n), m), "kfn", strict=True)]).collect()
        pieces = max(1, -(-n // m))
        for r in got:
            assert r.f <= r.id < r.f + r.n and r.n <= m and r.f == r.k * n // pieces, name
        if ranges:
            assert sorted({(r.f, r.f + r.n) for r in got}) == sorted((x.lo, x.hi) for x in ranges)


def test_a_killed_run_is_repeated(spark, survey, tmp_path):
    _, _, frames, files = survey
    source, mark, sink, manifest = (f"file://{tmp_path}/{n}" for n in ("in", "mark", "out", "done"))
    work = lambda f: P.predicted(f, *frames, RECIPE, model, 9)
    run = lambda w: P.predict_new_files(spark, source, "raw_file string, n_pings int, n_range int", mark, sink, manifest, w)
    whole = sorted(work(files).collect())
    rows = lambda: sorted(P.committed(spark, sink, manifest).select("raw_file", "ping_idx", "p_sandeel", "p_other").collect())
    files.filter("raw_file = 'a'").write.parquet(source)
    run(work)
    assert rows() == [r for r in whole if r.raw_file == "a"]

    def dies(left):
        work(left).withColumn("run", F.lit("half")).filter("ping_idx < 7").write.mode("append").parquet(sink)
        raise RuntimeError("killed")

    files.filter("raw_file <> 'a'").write.mode("append").parquet(source)
    with pytest.raises(Exception, match="killed"):
        run(dies)
    assert rows() == [r for r in whole if r.raw_file == "a"], "rows of an unfinished run are not seen"
    for _ in range(2):
        run(work)
        assert rows() == whole
    # a second run that commits the same file too changes nothing
    P.commit_files(files.filter("raw_file = 'b'"), sink, f"{manifest}-2", work)
    spark.read.parquet(f"{manifest}-2").write.mode("append").parquet(manifest)
    assert rows() == whole
    assert P.committed(spark, sink, f"{manifest}-none") is None and A.IGNORE == -100
