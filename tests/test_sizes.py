"""What larger tables ask of shared steps: profiles stay where they are stored, files are broadcast, blocks and ranges are bounded."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from echospark.operators import joins, labels, regrid, seabed, slices
from echospark.plans import queries as Q
from echospark.plans.queries import labelled
from echospark.sources import tables
from echospark.sources.fixtures import Survey

SF = "/root/testdata/sf0.001"
Q.load()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["entry_slice", "g5_g6_chains", "e15_regridded_pings", "c4_c5_missing_and_border", "a4_usable_surveys"])
def test_profiles_are_not_shuffled_by_ping(no_broadcast, name):
    text = plan(Q.QUERIES[name](no_broadcast, SF))
    lines = text.splitlines()
    if name != "a4_usable_surveys":
        assert "Bucketed: true" in text
    for at, line in enumerate(lines):
        # between a scan of profiles and the next exchange above it there is a join or an aggregate
        if "FileScan parquet" in line and "sv#" in line:
            depth = line.index("FileScan")
            above = [x for x in reversed(lines[:at]) if len(x) - len(x.lstrip(" :+-")) < depth]
            first = next(x for x in above if "Exchange" in x or "Join" in x or "Aggregate" in x)
            assert "Exchange" not in first


def test_surveys_are_padded_without_a_shuffle_of_profiles(no_broadcast):
    rows = no_broadcast.createDataFrame([(1, [1.0]), (1, [1.0, 2.0]), (2, [])], "survey int, sv array<double>")
    out = slices.pad_to_survey(rows, -1.0)
    assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
    assert sorted((r.survey, r.sv) for r in out.collect()) == [(1, [1.0, -1.0]), (1, [1.0, 2.0]), (2, [])]


def test_survey_cubes_do_not_shuffle_stored_profiles(no_broadcast):
    v = Survey(no_broadcast, SF)
    rows = v.sv.select("survey", "raw_file", "ping_idx", "freq_hz", "sv")
    parts = [rows.filter("ping_idx % 2 = 0").withColumn("sv", F.slice("sv", 1, 40)), rows.filter("ping_idx % 2 = 1")]
    lines = plan(tables.convert_survey(parts, labelled(v), v.seabed)).splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    assert sum("FileScan parquet" in x and "sv#" in x and "Bucketed: true" in x for x in lines) == 2
    for at, line in enumerate(lines):
        if "Exchange hashpartitioning(raw_file" in line:
            below = list(itertools.takewhile(lambda x: depth(x) > depth(line), lines[at + 1 :]))
            assert below and not any("sv#" in x for x in below)


def test_survey_cubes_of_parts_of_unlike_lengths(spark):
    table = lambda rows: spark.createDataFrame(rows, "survey int, raw_file string, ping_idx int, freq_hz int, sv array<double>")
    parts = [table([(1, "a", 0, 18, [1.0]), (1, "a", 0, 38, [2.0]), (2, "c", 0, 18, [])]), table([(1, "b", 0, 18, [3.0, 4.0, 5.0]), (1, "a", 1, 18, [6.0])])]
    marks = spark.createDataFrame([("a", 0, [7]), ("b", 0, [0, 8, 0, 9]), ("c", 0, [1])], "raw_file string, ping_idx int, labels array<int>")
    bottom = spark.createDataFrame([("a", 0, 1), ("b", 0, 2), ("b", 5, 1)], "raw_file string, ping_idx int, seabed_idx int")
    got = {(r.raw_file, r.ping_idx, r.freq_hz): (r.survey, ["nan" if math.isnan(x) else x for x in r.sv], r.labels, r.bottom) for r in tables.convert_survey(parts, marks, bottom).collect()}
    assert got == {
        ("a", 0, 18): (1, [1.0, "nan", "nan"], [7, 0, 0], [0, 1, 1]),
        ("a", 0, 38): (1, [2.0, "nan", "nan"], [7, 0, 0], [0, 1, 1]),
        ("a", 1, 18): (1, [6.0, "nan", "nan"], [0, 0, 0], [0, 0, 0]),
        ("b", 0, 18): (1, [3.0, 4.0, 5.0], [0, 8, 0], [0, 0, 1]),
        ("c", 0, 18): (2, [], [], []),
    }


def test_merged_categories_of_odd_masks(spark):
    nan = float("nan")
    rows = [("f", 0, 1, [1.0, nan, 0.0, 1.0]), ("f", 0, 27, [0.0, 1.0, nan, 2.0]), ("f", 0, -1, [9.0] * 4), ("f", 0, 5, [9.0] * 4), ("f", 1, 27, [0.0, nan]), ("f", 2, 1, [])]
    out = slices.merge_categories(spark.createDataFrame(rows, "raw_file string, ping_idx int, category int, mask array<double>"), (1, 27))
    assert {r.ping_idx: r.labels for r in out.collect()} == {0: [1, 27, 0, 27], 1: [0, 0], 2: []}
    assert "ObjectHashAggregate" not in plan(out)


def test_aligned_channels_move_profiles_once(no_broadcast):
    rows = [("f", 18, 0.0, [1.0, 2.0]), ("f", 18, 10.0, [3.0, 4.0]), ("f", 38, 11.0, [6.0]), ("f", 38, 9.0, [5.0]), ("f", 38, 21.0, [7.0])]
    out = joins.align_channels(no_broadcast.createDataFrame(rows, "raw_file string, freq_hz int, t double, sv array<double>"), 18)
    assert sum("Exchange hashpartitioning(raw_file" in x and "k#" in x for x in plan(out).splitlines()) == 1
    got = {(r.k, r.freq_hz): ["nan" if math.isnan(x) else x for x in r.sv] for r in out.collect()}
    gone = ["nan", "nan"]
    assert got == {(0, 18): [1.0, 2.0], (0, 38): gone, (1, 18): [3.0, 4.0], (1, 38): [5.0], (2, 18): gone, (2, 38): [7.0]}


def test_line_of_a_file_does_not_depend_on_its_blocks(spark):
    value = "transform(sequence(0, 29), r -> if((ping_idx div 3) % 5 = 2 or ping_idx > 60, 0.0D, double((ping_idx * 31 + r * r * 13 + freq_hz) % 97)))"
    sv = spark.range(64).select(F.lit("f").alias("raw_file"), F.col("id").cast("int").alias("ping_idx"), F.explode(F.array(F.lit(18), F.lit(38), F.lit(70))).alias("freq_hz")).withColumn("sv", F.expr(value))
    line = lambda size: sorted(map(tuple, seabed.seabed_line(sv, -0.5, size).collect()))
    whole = line(4096)
    assert len({x[2] for x in whole}) > 5 and line(4) == whole and line(7) == whole
    found = seabed.repaired(seabed.echo_strength(seabed.seabed_candidates(sv), 11), F.col("z") < -0.5)
    old = found.groupBy("raw_file", "ping_idx").agg(F.rint(F.median("candidate")).cast("int").alias("seabed_idx"))
    assert sorted(map(tuple, old.collect())) == whole


def test_echo_strength_of_odd_profiles(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("f", 18, 0, [9.0, 1.0, nan]), ("f", 18, 1, [9.0]), ("f", 18, 2, [0.0, -2.0, inf]), ("f", 18, 3, [0.0, -2.0]), ("f", 18, 4, [0.0, 3.0, None])]
    z = {r.ping_idx: r.z for r in seabed.echo_strength(spark.createDataFrame(rows, "raw_file string, freq_hz int, ping_idx int, sv array<double>").filter("ping_idx <> 3"), 1).collect()}
    m = [math.log(1e-10 + x) for x in (1.0, 0.0, 0.0, 3.0)]
    avg = sum(m) / 4
    dev = math.sqrt(sum((x - avg) ** 2 for x in m) / 4)
    assert [z[i] for i in (0, 1, 2, 4)] == pytest.approx([(x - avg) / dev for x in m])


@pytest.mark.parametrize("trace", [False, True])
def test_maps_are_masked_as_their_cells(spark, trace):
    maps = spark.range(40).select(F.lit("f").alias("raw_file"), F.col("id").cast("int").alias("ping_idx"), F.expr("transform(sequence(0, 19), r -> int((id * 7 + r) % 3))").alias("labels"))
    objects = spark.createDataFrame([("f", 5, 8, 2, 4), ("f", 7, 12, 3, 9), ("f", 30, 31, 15, 22)], "raw_file string, x0 int, x1 int, y0 int, y1 int")
    cells = maps.select("raw_file", "ping_idx", F.posexplode("labels").alias("r", "label"))
    want = sorted(map(tuple, labels.region_masked(cells, objects, 2, trace, compat=True).collect()))
    got = labels.region_masked(maps, objects, 2, trace, compat=True)
    assert got.columns == ["raw_file", "ping_idx", "r", "label"] and sorted(map(tuple, got.collect())) == want
    assert plan(got).index("Generate posexplode") < plan(got).index("Join")


def test_compaction_has_more_ranges_for_more_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "RANGE", 100, raising=False)
    rows = spark.range(1000).withColumn("x", F.col("id") * 2)
    tables.compact(rows, str(tmp_path / "t"), ["id"], 2)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 1000 and len(back.inputFiles()) == 10


def test_regridded_range_of_odd_profiles(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0, 3.0]), (1, [nan, 2.0, 3.0]), (2, [1.0]), (3, None), (4, []), (5, [4.0, None, nan])]
    out = spark.createDataFrame(rows, "k int, sv array<double>").select("k", regrid.regrid_range("sv", 0.25, 0.5, 3, 0.75, 2).alias("x"))
    got = {r.k: [None if x is None else "nan" if math.isnan(x) else round(x, 9) for x in r.x] for r in out.collect()}
    third = lambda a, b: round((a + b) / 3, 9)
    assert got == {0: [third(2, 2), third(2, 6)], 1: [2.0, third(2, 6)], 2: [1.0, "nan"], 3: [None, None], 4: ["nan", "nan"], 5: [4.0, "nan"]}


def test_energy_is_summed_without_lambdas(spark):
    rows = spark.createDataFrame([("f", [1.0, float("nan"), 2.0]), ("f", [4.0]), ("g", [float("nan")])], "raw_file string, sv array<double>")
    out = regrid.energy(rows, ["raw_file"])
    assert {r.raw_file: r.total for r in out.collect()} == {"f": 7.0, "g": 0.0} and "lambda" not in plan(out)


def test_announced_files_are_broadcast(no_broadcast):
    from echospark.plans.prediction import in_splits

    rows = no_broadcast.range(10).select(F.concat(F.lit("f"), F.col("id") % 1).alias("raw_file"), F.col("id").cast("int").alias("ping_idx"))
    files = no_broadcast.createDataFrame([("f0", 10)], "raw_file string, n_pings int")
    assert "BroadcastHashJoin" in plan(in_splits(rows, files, 4))
