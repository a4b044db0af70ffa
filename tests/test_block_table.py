"""Profiles stored in blocks of pings: the same results as from profiles by ping, without shuffling them."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from echospark.operators import seabed
from echospark.operators.blocks import BlockTable
from echospark.plans import patches as P
from echospark.plans import queries as Q
from echospark.plans.prediction import predicted
from echospark.plans.queries import labelled
from echospark.plans.query_jobs import _TRAIN
from echospark.sources import fixtures
from echospark.sources.fixtures import Survey

SF = "/root/testdata/sf0.001"
Q.load()


@pytest.fixture(scope="module")
def blocks(spark):
    """Blocks of 16 pings, so that a file of some 33 pings is several of them."""
    kept = fixtures.BLOCK, fixtures.HALO
    fixtures.BLOCK, fixtures.HALO = 16, 20
    fixtures._BLOCKS.clear()
    yield Survey(spark, SF).blocks
    fixtures.BLOCK, fixtures.HALO = kept
    fixtures._BLOCKS.clear()


def exchanges_of_profiles(df, aggregated: bool = True) -> list[str]:
    """Exchanges whose input reads profiles, that is whose subtree has a scan with the column sv; without those of aggregated rows if so asked."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if "Exchange" in line and (aggregated or not any("Aggregate" in below for below in lines[i + 1 : i + 4])):
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                if "FileScan" in below and "sv#" in below:
                    found.append(line.strip())
    return found


def test_blocks_hold_every_profile_once_and_their_halo(spark, blocks):
    v = Survey(spark, SF)
    same = lambda df: {(r.raw_file, r.ping_idx, r.freq_hz, r.h) for r in df.select("raw_file", "ping_idx", "freq_hz", F.xxhash64("sv").alias("h")).collect()}
    assert same(blocks.table()) == same(v.sv) and blocks.table().count() == v.sv.count()
    halo = blocks.rows.filter("not own").selectExpr("max(greatest(block * 16 - ping_idx, ping_idx - block * 16 - 15)) as most", "count(*) as n").first()
    assert halo.most == 20 and halo.n > 0


@pytest.mark.parametrize("most", [128, 3])
def test_patches_of_stored_blocks_are_those_of_pings(spark, blocks, monkeypatch, most):
    v = Survey(spark, SF)
    monkeypatch.setattr(P, "MOST", most)
    patches = v.ping.filter("e % 7 = 0").select("raw_file", F.col("e").alias("patch_id"), F.col("e").alias("key"), (F.col("e") % 60).cast("int").alias("cy"), (F.col("ping_idx") + F.col("e") % 41 - 20).cast("int").alias("cx"))
    made = lambda sv: P.patch_set(patches, _TRAIN, sv, labelled(v), v.seabed, v.ping)
    digest = lambda df: {tuple(r) for r in df.select("raw_file", "patch_id", "cy", "cx", F.xxhash64("data"), F.xxhash64("labels")).collect()}
    want = digest(made(v.sv))
    assert len(want) == patches.count() and digest(made(blocks)) == want
    # a halo that is too narrow for the window is not used
    assert digest(made(BlockTable(blocks.rows, blocks.size, 5, blocks.buckets))) == want


def test_stored_blocks_are_not_shuffled_for_patches(spark, blocks):
    v = Survey(spark, SF)
    patches = v.school.select("raw_file", F.col("object_id").alias("patch_id"), F.col("object_id").alias("key"), F.col("y0").alias("cy"), F.col("x0").alias("cx"))
    assert exchanges_of_profiles(P.patch_set(patches, _TRAIN, v.sv, labelled(v), v.seabed, v.ping))
    assert not exchanges_of_profiles(P.patch_set(patches, _TRAIN, blocks, labelled(v), v.seabed, v.ping))


@pytest.mark.parametrize("along", ["ping", "range"])
def test_survey_lines_of_stored_blocks_are_those_of_pings(spark, blocks, along):
    v = Survey(spark, SF)
    line = lambda sv: {tuple(r) for r in seabed.seabed_line_survey(sv, 13, 0, 40, along=along, size=50).collect()}
    want = line(v.sv)
    assert len(want) == v.ping.count() and line(blocks) == want
    # one file of a survey has pings of a single block
    few = v.ping.filter("ping_idx < 16 or raw_file <> '2024-01-13'").select("raw_file", "ping_idx")
    cut = blocks.rows.join(F.broadcast(few), ["raw_file", "ping_idx"], "left_semi").withColumn("end", F.col("end") | F.expr("raw_file = '2024-01-13' and ping_idx = 15"))
    assert line(replace(blocks, rows=cut)) == line(v.sv.join(few, ["raw_file", "ping_idx"], "left_semi"))


def test_stored_blocks_are_not_shuffled_for_survey_lines(spark, blocks):
    rows = seabed.seabed_candidates_in_blocks(blocks, 13, 0)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # only the profiles at the ends of files are, after they are aggregated
    assert "Window" in plan and not [x for x in exchanges_of_profiles(rows, aggregated=False)]


@pytest.mark.parametrize("split", [5000, 9])
def test_predictions_from_stored_blocks_are_those_of_pings(spark, blocks, split):
    v = Survey(spark, SF)
    model = lambda x: np.stack([np.zeros_like(x[:, 0], dtype=float), x[:, 0] / 20.0 + np.roll(x[:, 0], 1, axis=2) / 30.0, x[:, 1] / 20.0], axis=1)
    recipe = P.Recipe((18000, 38000), 16, 16, "evaluate", overlap=2, low=1e-7, high=4e-6)
    files = v.file.filter("raw_file > '2024-01-15'").select("raw_file", "n_pings", "n_range")
    made = lambda sv: predicted(files, sv, labelled(v), v.seabed, v.ping, recipe, model, split)
    rows = lambda df: {(r.raw_file, r.ping_idx, tuple(r.p_sandeel), tuple(r.p_other)) for r in df.collect()}
    want = rows(made(v.sv.drop("ping_time", "e")))
    got = made(blocks)
    assert len(want) > 400 and rows(got) == want
    assert not exchanges_of_profiles(got, aggregated=False)
