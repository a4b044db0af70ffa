"""Reading, cataloguing, converting and writing survey tables."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import point_in_interval
from ..operators.slices import longest_profiles, pad_to_survey, padded


def usable_files(files: DataFrame, freqs: Sequence[int], minimum: tuple[int, int], excluded: DataFrame | None = None, years: Sequence[int] | None = None) -> DataFrame:
    """Catalogue rows (survey, raw_file, freqs, n_pings, n_range, n_times, n_heave) that a job can use.

    All frequencies are there, both sides exceed the minimum, times and heave cover all pings,
    the file is not on the exclusion list, and the year is asked for.
    """
    want = F.array(*map(F.lit, freqs))
    ok = (F.size(F.array_except(want, "freqs")) == 0) & (F.col("n_range") > minimum[0]) & (F.col("n_pings") > minimum[1])
    out = files.filter(ok & (F.col("n_pings") == F.col("n_times")) & (F.col("n_pings") == F.col("n_heave")))
    if years is not None:
        out = out.filter(F.col("survey").isin(list(years)))
    return out if excluded is None else out.join(excluded.select("raw_file"), "raw_file", "left_anti")


def usable_surveys(sv: DataFrame, annotation: DataFrame, freqs: Sequence[int], categories: Sequence[int] = (27, 1)) -> DataFrame:
    """Surveys with all frequencies and all categories annotated."""
    have = sv.groupBy("survey").agg(F.collect_set("freq_hz").alias("f"))
    notes = annotation.groupBy("survey").agg(F.collect_set("category").alias("c"))
    need = lambda want, col: F.size(F.array_except(F.array(*map(F.lit, want)), col)) == 0
    return have.join(notes, "survey").filter(need(freqs, "f") & need(categories, "c")).select("survey")


#: Object table columns as found in files, and as used here.
OBJECT_COLUMNS = {
    "object": "object_id",
    "upperdeptindex": "y0",
    "upperdepthindex": "y0",
    "lowerdeptindex": "y1",
    "lowerdepthindex": "y1",
    "startpingindex": "x0",
    "endpingindex": "x1",
}


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """An object CSV with its columns renamed."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    return raw.withColumnsRenamed({k: v for k, v in OBJECT_COLUMNS.items() if k in raw.columns})


def read_transects(spark: SparkSession, path: str) -> DataFrame:
    """start_time, stop_time of a transect CSV, and its other columns."""
    raw = spark.read.csv(path, header=True)
    times = [F.to_timestamp_ntz("StartDateTime").alias("start_time"), F.to_timestamp_ntz("StopDateTime").alias("stop_time")]
    return raw.select(*[c for c in raw.columns if c not in ("StartDateTime", "StopDateTime")], *times)


def transect_pings(transects: DataFrame, pings: DataFrame, width: float = 3600.0) -> DataFrame:
    """transects(raw_file, start_time, stop_time), pings(raw_file, ping_idx, ping_time) -> raw_file, start, stop: the pings of each transect that has any, stop excluded."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    spans = transects.select("raw_file", seconds("start_time").alias("__lo"), seconds("stop_time").alias("__hi"))
    hit = point_in_interval(pings.select("raw_file", "ping_idx", seconds("ping_time").alias("__t")), spans, "raw_file", "__t", "__lo", "__hi", width)
    return hit.groupBy("raw_file", "__lo", "__hi").agg(F.min("ping_idx").alias("start"), (F.max("ping_idx") + 1).alias("stop")).select("raw_file", "start", "stop")


def valid_ranges(files: DataFrame, ranges: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """raw_file, start, stop: the given ping ranges, and the whole file where there are none.

    described: files whose transects are known; of these only the ranges count, even if there are none.
    """
    rest = files.join(ranges if described is None else described, "raw_file", "left_anti").select("raw_file", F.lit(0).alias("start"), F.col("n_pings").alias("stop"))
    return ranges.select("raw_file", "start", "stop").unionByName(rest)


def parsed_time(text: Column) -> Column:
    """A timestamp with or without a fraction of seconds."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def read_external_mask(spark: SparkSession, path: str) -> DataFrame:
    """time, pingNumber, depthRanges of an external mask JSON array."""
    schema = "time string, pingNumber bigint, depthRanges array<struct<min:double,max:double>>"
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("time", parsed_time(F.col("time")))


def new_rows(df: DataFrame, stored: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not stored yet."""
    if stored is None:
        return df
    seen = stored.select(*keys).distinct()
    # names of files are few; rows must not be shuffled by them
    return df.join(F.broadcast(seen) if list(keys) == ["raw_file"] else seen, list(keys), "left_anti")


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at path, None where nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_predictions(df: DataFrame, path: str, resume: bool = True) -> None:
    """Writes predictions by survey; with resume, only (raw_file, ping_idx) that are not there yet."""
    spark, stored = df.sparkSession, None
    if resume:
        stored = stored_table(spark, path)
    rows = new_rows(df, stored, ["raw_file", "ping_idx"]).repartition("survey", "raw_file").sortWithinPartitions("survey", "raw_file", "ping_idx")
    rows.write.partitionBy("survey").mode("append" if resume else "overwrite").parquet(path)


#: Rows of a range of a compacted table, on average; one task sorts a range.
RANGE = 1 << 18


def compact(df: DataFrame, path: str, keys: Sequence[str], files: int, max_records: int = 1_000_000) -> None:
    """Rewrites a table in ranges of its keys, sorted, with bounded files: at least `files` ranges, and more of them for more than RANGE rows each."""
    ranges = max(files, -(-df.count() // RANGE))
    df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", max_records).option("compression", "zstd").parquet(path)


def stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """The rows of all parts, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_survey(parts: Sequence[DataFrame]) -> DataFrame:
    """Files' profile tables stacked and padded to the survey's longest profile."""
    return pad_to_survey(stacked(parts))


def convert_survey(parts: Sequence[DataFrame], labels: DataFrame, seabed: DataFrame) -> DataFrame:
    """Files' profiles(survey, raw_file, ping_idx, freq_hz, sv) as cubes: sv padded with NaN, labels padded with 0, and `bottom`, 1 at and below the seabed, all as long as the survey's longest profile.

    Parts meet the marks of their pings one by one, so give few and large parts: stacked parts lose
    the buckets that they are stored in, and a join by ping would shuffle and sort all profiles.
    """
    keys = ["raw_file", "ping_idx"]
    marks = labels.select(*keys, "labels").join(seabed.select(*keys, "seabed_idx"), keys, "left")
    cube = pad_to_survey(stacked([p.join(marks, keys, "left") for p in parts]), longest=longest_profiles(stacked(parts)))
    n = F.size("sv")
    wide = cube.withColumn("labels", padded(F.slice(F.coalesce("labels", F.array().cast("array<int>")), F.lit(1), n), n, 0))
    below = F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.coalesce((r >= F.col("seabed_idx")).cast("int"), F.lit(0)))
    return wide.withColumn("bottom", F.when(n > 0, below).otherwise(F.array().cast("array<int>"))).drop("seabed_idx")


def _plain(path: Column) -> Column:
    """A path without scheme and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:", ""), "/+", "/")


def read_dense(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Raw float32 C-order [range, ping] matrices -> raw_file, freq_hz, ping_idx, sv, source, reason.

    manifest(path, raw_file, freq_hz, n_range, n_pings) describes each file by its path below the
    folder `path`, all subfolders included. A file without a manifest row, or whose size does not
    fit it, gives one row with a reason (ping_idx -1, empty sv); `quarantined` has those.
    """
    root = re.sub("/+", "/", re.sub("^[A-Za-z][A-Za-z0-9+.-]*:", "", path)).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.replace(_plain(F.col("path")), F.lit(root), F.lit("")).alias("source"), "content")
    named = files.join(manifest.withColumn("source", F.regexp_replace("path", "^/+", "")).drop("path"), "source", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, m = row["n_range"], row["n_pings"]
                reason = "not in the manifest" if n is None else "size does not fit" if len(row["content"]) != 4 * n * m else None
                data = np.zeros((0, 0), "<f4") if reason else np.frombuffer(row["content"], dtype="<f4").reshape(n, m).T
                count = 1 if reason else m
                sv = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * (0 if reason else n)), pa.array(np.ascontiguousarray(data).ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["raw_file"]] * count, pa.string()),
                        pa.array([row["freq_hz"]] * count, pa.int32()),
                        pa.array([-1] if reason else np.arange(count), pa.int32()),
                        sv,
                        pa.array([row["source"]] * count, pa.string()),
                        pa.array([reason] * count, pa.string()),
                    ],
                    ["raw_file", "freq_hz", "ping_idx", "sv", "source", "reason"],
                )

    return named.mapInArrow(run, "raw_file string, freq_hz int, ping_idx int, sv array<double>, source string, reason string")


def quarantined(dense: DataFrame, manifest: DataFrame) -> DataFrame:
    """source, reason of what read_dense could not use: bad files, and manifest rows without a file."""
    seen = dense.select("source", "reason").distinct()
    gone = manifest.select(F.regexp_replace("path", "^/+", "").alias("source")).join(seen, "source", "left_anti").withColumn("reason", F.lit("no file"))
    return seen.filter("reason is not null").unionByName(gone)


def inventory(listing: DataFrame) -> DataFrame:
    """listing(cruise, kind, std_loc) -> cruise and the count of each kind at standard and other places."""
    kind = F.concat_ws("_", "kind", F.when(F.col("std_loc"), "std").otherwise("other"))
    names = [f"{k}_{p}" for k in ("raw", "snap", "work") for p in ("std", "other")]
    return listing.withColumn("k", kind).groupBy("cruise").pivot("k", names).count().na.fill(0, names)


def paired_files(raw: DataFrame, snap: DataFrame, work: DataFrame) -> DataFrame:
    """stem, has_work of stems that have raw and snap files."""
    marked = lambda df, name: df.select("stem").distinct().withColumn(name, F.lit(True))
    joined = marked(raw, "r").join(marked(snap, "s"), "stem", "full_outer").join(marked(work, "w"), "stem", "full_outer")
    return joined.filter("r and s").select("stem", F.coalesce("w", F.lit(False)).alias("has_work"))


def worklist(files: DataFrame, status: DataFrame) -> DataFrame:
    """Files whose latest status (status(stem, at, code)) is zero, negative or missing."""
    latest = status.groupBy("stem").agg(F.max_by("code", "at").alias("code"))
    return files.join(latest, "stem", "left").withColumn("code", F.coalesce("code", F.lit(0))).filter("code <= 0")
