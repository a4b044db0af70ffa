"""Seabed lines of files and surveys against serial versions over whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.functions import acoustic as A
from echospark.operators import blocks, sampling, seabed

#: The kernels of slope and curvature.
SLOPE = np.array([[1, 2, 1], [0, 0, 0], [-1, -2, -1]])
BEND = np.array([[1, 5, 1], [-2, -10, -2], [1, 5, 1]])


def convolved(data, kernel):
    """True two-dimensional convolution with zeros beyond the edges, as large as data."""
    wide = np.pad(data, 1)
    out = np.zeros(data.shape)
    for i in range(3):
        for j in range(3):
            out += kernel[i, j] * wide[2 - i : 2 - i + data.shape[0], 2 - j : 2 - j + data.shape[1]]
    return out


def score(data):
    return np.where(convolved(data, SLOPE) > 0, convolved(data, BEND), 0)


def frame(spark, cubes, survey=2010):
    """cubes: raw_file -> (range, ping) matrix or list of them by frequency."""
    rows = []
    for name, by_freq in cubes.items():
        for f, data in enumerate(by_freq):
            rows += [(survey, name, 1000 * (f + 1), p, data[:, p].tolist()) for p in range(data.shape[1])]
    return spark.createDataFrame(rows, "survey int, raw_file string, freq_hz int, ping_idx int, sv array<double>").repartition(3)


def edge(pings, height=100, at=60, rng=None):
    """A rising edge of three rows, as a seabed echo looks."""
    data = np.full((height, pings), 1.0)
    data[at : at + 3] = [[20.0], [60.0], [50.0]]
    data[at + 3 :] = 30.0
    return data if rng is None else data * rng.uniform(0.5, 1.5, data.shape)


@pytest.mark.parametrize("noisy", [False, True])
def test_candidates_are_those_of_the_kernels(spark, noisy):
    data = edge(40, rng=np.random.default_rng(1) if noisy else None)
    data[70, 3], data[20, 5], data[10, 6] = np.nan, np.inf, -np.inf
    clean = np.where(np.isfinite(data), data, 0.0)
    for along, matrix in (("range", clean), ("ping", clean.T)):
        s = score(matrix)
        want = 15 - 2 + (s[15:].argmax(axis=0) if along == "range" else s[:, 15:].argmax(axis=1))
        got = [r.candidate for r in seabed.seabed_candidates(frame(spark, {"f": [data]}), 15, 2, along).orderBy("ping_idx").collect()]
        assert got == want.tolist()
    if not noisy:
        # the row ahead of the echo: there the second difference is largest and the slope rises
        assert {r.candidate for r in seabed.seabed_candidates(frame(spark, {"f": [edge(5)]}), 15, 0).collect()} == {60}


def serial_repair(line, weak, first, edge_, in_tail):
    line, n, i = line.astype(float), len(line), first
    while i < (n if in_tail else n - edge_):
        if not weak[i]:
            i += 1
            continue
        lo = i
        while i < n and weak[i]:
            i += 1
        hi = i - 1
        if lo <= first:
            line[lo : hi + 1] = line[hi + 1] if hi + 1 < n else line[lo - 1]
        elif hi >= n - edge_:
            line[lo : hi + 1] = line[lo - 1]
        else:
            line[lo : hi + 1] = (line[lo - 1] + line[hi + 1]) / 2
    return line


def test_line_of_a_file(spark):
    rng = np.random.default_rng(3)
    cubes = {}
    for name in ("a", "b"):
        cubes[name] = [edge(400, at=50 + 5 * k, rng=rng) for k in range(3)]
        for k, data in enumerate(cubes[name]):
            for lo, hi in ((0, 1), (2, 3), (100 + k, 102), (300, 300), (398, 400))[k : k + 3]:
                data[:, lo:hi] = 0.0
    want = {}
    for name, by_freq in cubes.items():
        lines = []
        for data in by_freq:
            n0 = 10 + int(0.05 * len(data))
            m = np.log(1e-10 + data[n0:].max(axis=0))
            weak = (m - m.mean()) / m.std() < -8
            assert weak.any()
            lines.append(serial_repair(n0 - int(0.004 * len(data)) + score(data)[n0:].argmax(axis=0), weak, 2, 2, False))
        want |= {(name, p): int(x) for p, x in enumerate(np.rint(np.median(lines, axis=0)))}
    got = {(r.raw_file, r.ping_idx): r.seabed_idx for r in seabed.seabed_line(frame(spark, cubes)).collect()}
    assert got == want


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_line_of_a_survey_in_blocks(spark, size):
    """Files follow one another; islands, windows and stencils cross files and blocks."""
    rng = np.random.default_rng(size)
    cubes, lengths = {}, {"2010-a": 90, "2010-b": 1, "2010-c": 140}
    at = 30 + np.cumsum(rng.integers(-1, 2, sum(lengths.values())))
    at[[2, 3, 60, 61, 62, 63, 64, 65, 66, 67, 68, 89, 90, 91, -2, -1]] += 25
    for f in range(2):
        whole = rng.uniform(0.1, 1.0, (90, len(at)))
        for p, r in enumerate(at + f):
            whole[r, p] += 80.0 * (1 + p % 3)
        start = 0
        for name, n in lengths.items():
            cubes.setdefault(name, []).append(whole[:, start : start + n])
            start += n
    for along in ("range", "ping"):
        lines = []
        for f in range(2):
            data = np.concatenate([cubes[name][f] for name in sorted(cubes)], axis=1)
            line = 15 + (score(data)[15:].argmax(axis=0) if along == "range" else score(data.T)[:, 15:].argmax(axis=1))
            weak = np.zeros(len(line), dtype=bool)
            for i in range(len(line)):
                near = line[max(0, i - 20) : i + 20]
                n, s, q = len(near), int(near.sum()), int((near * near).sum())
                # |x - mean| / deviation > 3 / 4 in whole numbers
                weak[i] = i >= 2 and 16 * (n * int(line[i]) - s) ** 2 > 9 * (n * q - s * s)
            lines.append(serial_repair(line, weak, 2, 2, True))
        want = np.rint(np.median(lines, axis=0)).astype(int).tolist()
        out = seabed.seabed_line_survey(frame(spark, cubes), 15, 0, 40, along=along, size=size)
        assert [r.seabed_idx for r in out.orderBy("raw_file", "ping_idx").collect()] == want


def test_halo_and_nearest_known(spark):
    rows = spark.range(23).select(F.lit("k").alias("k"), F.col("id").alias("p"), (F.col("id") % 5 == 2).alias("ok"))
    halo = [(r.block, r.p, r.own) for r in blocks.with_halo(rows, "p", 2, 1, 6).collect()]
    assert sorted(halo) == sorted((b, p, b == p // 6) for b in range(5) for p in range(23) if 6 * b - 2 <= p <= 6 * b + 6)
    got = {r.p: (r.before and r.before.at, r.after and r.after.at, r.last) for r in blocks.nearest_known(rows, ["k"], "p", F.col("ok"), F.col("p"), 4).collect()}
    known = [2, 7, 12, 17, 22]
    assert got == {p: (max((k for k in known if k < p), default=None), min((k for k in known if k > p), default=None), 22) for p in range(23)}


def test_windows_with_a_point(spark):
    """Centres lie half a window less the slack from the point and from the ends at most."""
    rng = np.random.default_rng(8)
    rows = [(int(n), int(y), float(u)) for n, y, u in zip(rng.integers(1, 400, 500), rng.integers(0, 400, 500), rng.random(500), strict=True) if y < n]
    df = spark.createDataFrame(rows, "n int, y int, u double").select("*", sampling.window_with_point(F.col("y"), F.col("n"), 100, F.col("u"), 20).alias("c"))
    for r in df.collect():
        if r.n <= 100:
            assert r.c == r.n // 2
        else:
            lo, hi = max(30, r.y - 30), min(r.n - 30, r.y + 30)
            assert r.c == (hi if lo == hi else int(np.floor(lo + r.u * (hi - lo))))


def test_jitter_reaches_both_ends(spark):
    values = [r.j for r in spark.range(5000).select(sampling.jitter(A.keyed_uniform(F.col("id"), 3), 8).alias("j")).distinct().collect()]
    assert sorted(values) == list(range(-4, 5))
