"""Patch sets against a serial version in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.functions import acoustic as A
from echospark.plans import patches as P

FREQS = (18000, 200000)


def test_keyed_uniform_is_that_of_the_columns(spark):
    keys = np.r_[np.arange(200), 2**40 + np.arange(50)]
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    got = [r.u for r in df.select("k", A.keyed_uniform(F.col("k"), 17).alias("u")).orderBy("k").collect()]
    assert got == P.keyed_uniform(keys, 17).tolist()


def test_closing_of_small_and_large_masks():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (2, 5), (3, 40), (30, 30)):
        mask = rng.random((h, w)) < 0.3
        disc = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 10]
        cell = lambda m, y, x: 0 <= y < m.shape[0] and 0 <= x < m.shape[1] and m[y, x]
        grown = np.array([[any(cell(mask, y - dy, x - dx) for dy, dx in disc) for x in range(w)] for y in range(h)])
        want = np.array([[all(cell(grown, y - dy, x - dx) for dy, dx in disc) for x in range(w)] for y in range(h)])
        assert (P.closed(mask) == want).all()


@pytest.fixture(scope="module")
def survey(spark):
    rng = np.random.default_rng(2)
    n, h = 14, 20
    sv = 10.0 ** rng.uniform(-9, -3, (2, n, h))
    sv[0, 3, 4], sv[1, 5, 6] = np.nan, np.inf
    marks = rng.choice([0, 0, 0, 27, 1, 6009], (n, h))
    marks[4:9, 3:12] = 27
    bottom = rng.integers(6, 15, n)
    seconds = np.cumsum(rng.integers(1, 9, n))
    rows = [("f", p, FREQS[k], sv[k, p].tolist()) for k in range(2) for p in range(n)]
    frames = (
        spark.createDataFrame(rows, "raw_file string, ping_idx int, freq_hz int, sv array<double>"),
        spark.createDataFrame([("f", p, marks[p].tolist()) for p in range(n)], "raw_file string, ping_idx int, labels array<int>"),
        spark.createDataFrame([("f", p, int(bottom[p])) for p in range(n)], "raw_file string, ping_idx int, seabed_idx int"),
        spark.createDataFrame([("f", p, int(seconds[p])) for p in range(n)], "raw_file string, ping_idx int, s long").withColumn("ping_time", F.timestamp_seconds(F.col("s") + 1_262_400_000).cast("timestamp_ntz")).drop("s"),
    )
    return sv, marks, bottom, seconds + 1_262_400_000, frames


CENTRES = [(5, 5), (0, 0), (19, 13), (-6, 40), (10, -3), (12, 7)]


@pytest.mark.parametrize("chain, seed", [("train", None), ("train", 4), ("evaluate", None)])
def test_patches_that_leave_the_file_on_all_sides(spark, survey, chain, seed):
    sv, marks, bottom, seconds, frames = survey
    n, h = marks.shape
    r = P.Recipe(FREQS, 8, 6, chain, P.META if chain == "train" else (), chain == "train", seed, 1 if chain == "evaluate" else 0)
    patches = spark.createDataFrame([("f", f"p{i}", 100 + i, cy, cx) for i, (cy, cx) in enumerate(CENTRES)], "raw_file string, patch_id string, key long, cy int, cx int")
    got = {x.patch_id: x for x in P.patch_set(patches, r, *frames).collect()}
    assert len(got) == len(CENTRES) and len(r.channels()) == (9 if chain == "train" else 2)
    days = seconds / 86400
    steps = np.r_[days[1] - days[0], (days[2:] - days[:-2]) / 2, days[-1] - days[-2]] / 6e-6 - 1
    for i, (cy, cx) in enumerate(CENTRES):
        data, labels = np.zeros((2, 8, 6)), np.full((8, 6), -100)
        under = np.zeros((8, 6), dtype=bool)
        for y in range(8):
            for x in range(6):
                p, q = cx - 3 + 1 + x, cy - 4 + 1 + y
                if 0 <= p < n and 0 <= q < h:
                    data[:, y, x], labels[y, x] = np.nan_to_num(sv[:, p, q], nan=0.0, posinf=0.0), marks[p, q]
                if 0 <= p < n:
                    under[y, x] = q >= bottom[p] + 10
        planes = []
        if chain == "train":
            at = np.clip(cx - 3 + np.arange(6), 0, n - 1)
            rows = (cy - 4 + np.arange(8))[:, None] + np.zeros((1, 6))
            turn = 2 * np.pi * ((days + 719529) % 1)[np.clip(cx, 0, n - 1)]
            flat = lambda v: np.broadcast_to(v, (8, 6))
            planes = [flat(1 / 12 + 2 / 366 + (seconds[0] % 86400 // 3600) / 366 / 24), flat(np.sin(turn)), flat(np.cos(turn)), flat(steps[at]), rows / bottom[at], rows / 8, (bottom[at] - rows) / 8]
        if seed is not None:
            data = P.noisy(data, 100 + i, seed)
            if P.keyed_uniform(np.array([100 + i]), seed + 4)[0] < 0.5:
                data, labels, planes = data[:, :, ::-1], labels[:, ::-1], [v[:, ::-1] for v in planes]
        code = lambda v: np.select([v == 0, v == 27, v == 1], [0, 1, 2], -100)
        if chain == "train":
            labels = code(P.refined(labels, data[1], 1e-7, 1e-4))
            db = 1 + np.clip(10 * np.log10(data + 1e-10), -75, 0) / 75
        else:
            labels = P.refined(np.where(labels == 6009, -10, code(labels)), data[1], 1e-7, 1e-4)
            labels = np.where((labels == 0) & under, -50, labels)
            edge = np.ones((8, 6), dtype=bool)
            edge[1:-1, 1:-1] = False
            labels = np.where(edge & (labels != -100), -70, labels)
            db = np.where(labels == -100, 0.0, np.clip(10 * np.log10(data + 1e-10), -75, 0))
        row = got[f"p{i}"]
        assert (row.cy, row.cx) == (cy, cx) and row.labels == labels.ravel().tolist()
        want = np.concatenate([db, *([np.stack(planes)] if planes else [])])
        np.testing.assert_allclose(np.array(row.data), want.reshape(len(want), -1), rtol=2e-6, atol=1e-6)


def test_noise_changes_a_twentieth_of_half_the_patches():
    data = np.ones((4, 64, 64))
    changed = [(P.noisy(data, key, 7) != 1).mean() for key in range(60)]
    assert 15 < sum(c > 0 for c in changed) < 45
    assert all(c == 0 or 0.04 < c < 0.06 for c in changed)
    assert max(P.noisy(data, key, 7).max() for key in range(20)) > 9


def test_stored_patches_are_not_made_again(spark, survey, tmp_path):
    r = P.Recipe(FREQS, 8, 6)
    patches = spark.createDataFrame([("f", i, i, cy, cx) for i, (cy, cx) in enumerate(CENTRES)], "raw_file string, patch_id int, key long, cy int, cx int")
    seen = []

    def make(left):
        seen.append(left.count())
        return P.patch_set(left, r, *survey[4])

    for part in (patches.filter("patch_id < 2"), patches, patches):
        P.store_patches(part, f"file://{tmp_path}/set", make)
    stored = spark.read.parquet(f"file://{tmp_path}/set")
    assert seen == [2, 4, 0] and sorted(x.patch_id for x in stored.collect()) == list(range(6))
