"""Raw matrices: written, described, read in parts, quarantined, ingested again after a failure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.sources import matrices as M

SV = "raw_file string, freq_hz int, ping_idx long, sv array<double>"


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(1)
    rows = [(name, f, p, rng.random(7).astype("<f4").astype(float).tolist()) for name, n in (("a", 45), ("b", 10)) for f in (18000, 38000) for p in range(n)]
    return rows, spark.createDataFrame(rows, SV).repartition(5)


def test_parts_of_written_matrices(spark, cube, tmp_path):
    rows, sv = cube
    manifest = M.write_matrices(sv, f"file://{tmp_path}/m", 20)
    assert {(r.raw_file, r.first_ping, r.n_pings) for r in manifest.collect()} == {("a", 0, 20), ("a", 20, 20), ("a", 40, 5), ("b", 0, 10)}
    raw = np.fromfile(tmp_path / "m/a/18000/00000001.dat", dtype="<f4").reshape(7, 20)
    assert raw[:, 3].tolist() == next(r[3] for r in rows if r[:3] == ("a", 18000, 23))
    parts = M.parts_of(manifest, 4 * 7 * 6)
    assert {(r.lo, r.hi) for r in parts.filter("n_pings = 20").collect()} == {(0, 6), (6, 12), (12, 18), (18, 20)}
    read = M.read_matrices(spark, f"file://{tmp_path}/m", parts, 4 * 7 * 12)
    assert read.rdd.getNumPartitions() > 4, "one matrix is several tasks"
    assert sorted((r.raw_file, r.freq_hz, r.ping_idx, r.sv) for r in read.collect()) == sorted(rows)


def test_quarantine_and_a_second_run(spark, cube, tmp_path):
    rows, sv = cube
    root, target, bad = (f"file://{tmp_path}/{n}" for n in ("m", "t", "q"))
    manifest = M.write_matrices(sv, root, 20)
    lost = tmp_path / "m/b/18000/00000000.dat"
    short = tmp_path / "m/a/38000/00000002.dat"
    kept, whole = lost.read_bytes(), short.read_bytes()
    lost.unlink()
    short.write_bytes(whole[:-3])
    M.ingest(spark, root, manifest, target, bad, 4 * 7 * 4)
    stored = lambda: sorted((r.raw_file, r.freq_hz, r.ping_idx, r.sv) for r in spark.read.parquet(target).collect())
    gone = lambda r: r[:2] == ("b", 18000) or r[:2] == ("a", 38000) and r[2] >= 40
    assert stored() == sorted(r for r in rows if not gone(r))
    reasons = {(r.source, r.lo): r.reason for r in spark.read.parquet(bad).collect()}
    assert reasons == {**{("b/18000/00000000.dat", lo): "no file" for lo in (0, 4, 8)}, **{("a/38000/00000002.dat", lo): "size does not fit" for lo in (0, 4)}}
    lost.write_bytes(kept)
    short.write_bytes(whole)
    for _ in range(2):
        M.ingest(spark, root, manifest, target, bad, 4 * 7 * 4)
        assert stored() == sorted(rows)
        assert spark.read.parquet(bad).count() == 0


def test_no_matrices(spark, tmp_path):
    manifest = spark.createDataFrame([], M.MANIFEST)
    assert M.read_matrices(spark, f"file://{tmp_path}", M.parts_of(manifest)).count() == 0
    one = spark.createDataFrame([("x.dat", "f", 18000, 4, 0, None)], M.MANIFEST)
    (tmp_path / "x.dat").write_bytes(b"")
    assert M.read_matrices(spark, f"file://{tmp_path}", M.parts_of(one)).count() == 0
    assert M.parts_of(one).select(F.max("hi")).first()[0] == 0
