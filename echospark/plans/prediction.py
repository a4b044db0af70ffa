"""Prediction of whole files by a model of patches: splits, tiles, chains, scores, profiles, and commits by a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import acoustic as A
from ..operators import slices
from ..operators.blocks import BlockTable
from ..sources.tables import stored_table
from .patches import Recipe, patch_set

#: (patch, channel, height, width) of prepared data -> (patch, 3, height, width) scores of background, sandeel and other.
Model = Callable[[np.ndarray], np.ndarray]
#: Pings of a split.
SPLIT = 5000


def split_of(ping: Column, n: Column, max_n: int) -> tuple[Column, Column, Column]:
    """(number, first ping, pings) of the split of a file of n pings that holds a ping; edges as in slices.split_ranges."""
    pieces = F.greatest(F.ceil(n / F.lit(float(max_n))), F.lit(1))
    edge = lambda i: F.floor(i * n / pieces)
    near = F.floor(ping * pieces / n)
    k = F.when(ping >= edge(near + 1), near + 1).when(ping < edge(near), near - 1).otherwise(near)
    return k.cast("int"), edge(k).cast("int"), (edge(k + 1) - edge(k)).cast("int")


def in_splits(rows: DataFrame, files: DataFrame, max_n: int = SPLIT) -> DataFrame:
    """rows(raw_file, ping_idx) with the split as their raw_file and pings counted from its start; `of_file` and `first` lead back."""
    k, first, _ = split_of(F.col("ping_idx"), F.col("__n"), max_n)
    # names of files are few; profiles must not be shuffled by them
    named = rows.join(F.broadcast(files.select("raw_file", F.col("n_pings").alias("__n"))), "raw_file").withColumns({"__k": k, "first": first, "of_file": F.col("raw_file")})
    return named.withColumns({"raw_file": F.concat_ws("#", "of_file", "__k"), "ping_idx": F.col("ping_idx") - F.col("first")}).drop("__n", "__k")


def scored_patches(patches: DataFrame, recipe: Recipe, model: Model) -> DataFrame:
    """patches(patch_set) -> raw_file, ping_idx, top, p1, p2: probabilities of sandeel and other in the columns of the patches' interiors.

    The arrays start at range bin `top`; columns beyond the limits of a patch (lo, hi) are left out. Cells with the codes OVERLAP, SEABED or IGNORE are 0; numbers are
    rounded to half precision, as predictions are stored.
    """
    r = recipe
    own_cols = np.arange(r.overlap, r.width - r.overlap)
    limited = "lo" in patches.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = row.column("data").flatten().flatten().to_numpy(zero_copy_only=False).reshape(1, -1, r.height, r.width)
                labels = row.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(r.height, r.width)
                s = np.asarray(model(data), dtype=float)[0]
                e = np.exp(s - s.max(axis=0))
                p = np.where(np.isin(labels, (A.OVERLAP, A.SEABED, A.IGNORE)), 0.0, e[1:] / e.sum(axis=0)).astype(np.float16).astype(np.float32)
                cy, cx = row.column("cy")[0].as_py(), row.column("cx")[0].as_py()
                cols = own_cols
                if limited:
                    at = cx - r.width // 2 + 1 + cols
                    cols = cols[(at >= row.column("lo")[0].as_py()) & (at < row.column("hi")[0].as_py())]
                inner = p[:, r.overlap : r.height - r.overlap, cols].swapaxes(1, 2)
                at = pa.array(np.arange(len(cols) + 1, dtype=np.int32) * inner.shape[2])
                lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).ravel())) for x in inner]
                top = cy - r.height // 2 + 1 + r.overlap
                names = ["raw_file", "ping_idx", "top", "p1", "p2"]
                yield pa.RecordBatch.from_arrays([pa.array(row.column("raw_file").to_pylist() * len(cols)), pa.array((cx - r.width // 2 + 1 + cols).astype(np.int32)), pa.array([top] * len(cols), pa.int32()), *lists], names)

    return patches.mapInArrow(run, "raw_file string, ping_idx int, top int, p1 array<float>, p2 array<float>")


def predicted(files: DataFrame, sv: DataFrame | BlockTable, labels: DataFrame, bottom: DataFrame, pings: DataFrame, recipe: Recipe, model: Model, max_n: int = SPLIT) -> DataFrame:
    """files(raw_file, n_pings, n_range) -> raw_file, ping_idx, p_sandeel, p_other: whole profiles of all their pings.

    Files are cut into splits of at most max_n pings, each tiled on its own, so pings beyond a split are
    border cells of its patches. Interiors tile a split without gaps from bin 0 on; the pieces of a
    ping are put in order and filled up with 0 below the last tile. Pieces, not cells, are shuffled. Profiles that are
    stored in blocks stay there: patches of a split are made from the file's blocks and see the pings of their split.
    """
    part = lambda df: in_splits(df.join(F.broadcast(files.select("raw_file")), "raw_file", "left_semi"), files, max_n)
    ranges = slices.split_ranges(files.withColumn("start", F.lit(0)).withColumn("stop", F.col("n_pings")), max_n)
    k = split_of(F.col("lo"), F.col("n_pings"), max_n)[0]
    splits = ranges.filter("hi > lo").select(F.concat_ws("#", "raw_file", k).alias("raw_file"), (F.col("hi") - F.col("lo")).alias("n_pings"), "n_range", F.col("raw_file").alias("of_file"), F.col("lo").alias("first"))
    own_bottom = part(bottom)
    grid = slices.tiles(splits, own_bottom, recipe.height, recipe.overlap).withColumn("key", F.lit(0))
    whole = lambda p: F.slice(slices.padded(F.flatten(F.transform("pieces", lambda x: x[p])), F.col("n_range"), F.lit(0).cast("float")), F.lit(1), F.col("n_range"))
    ordered = F.array_sort(F.collect_list(F.struct("top", "p1", "p2"))).alias("pieces")
    if isinstance(sv, BlockTable) and not recipe.meta:
        # splits of long files are many: they are not broadcast
        limits = splits.select("raw_file", "of_file", "first", F.col("first").alias("lo"), (F.col("first") + F.col("n_pings")).alias("hi"))
        grid = grid.join(limits.hint("shuffle_hash"), "raw_file").select(F.col("of_file").alias("raw_file"), "patch_id", "key", "cy", (F.col("cx") + F.col("first")).alias("cx"), "lo", "hi")
        pieces = scored_patches(patch_set(grid, recipe, sv, labels, bottom, pings), recipe, model).groupBy("raw_file", "ping_idx").agg(ordered)
        out = pieces.join(F.broadcast(files.select("raw_file", "n_range")), "raw_file")
        return out.select("raw_file", "ping_idx", whole("p1").alias("p_sandeel"), whole("p2").alias("p_other"))
    sv = sv.table() if isinstance(sv, BlockTable) else sv
    done = scored_patches(patch_set(grid, recipe, part(sv), part(labels), own_bottom, part(pings)), recipe, model)
    out = done.groupBy("raw_file", "ping_idx").agg(ordered).join(splits, "raw_file").filter("ping_idx >= 0 and ping_idx < n_pings")
    return out.select(F.col("of_file").alias("raw_file"), (F.col("ping_idx") + F.col("first")).alias("ping_idx"), whole("p1").alias("p_sandeel"), whole("p2").alias("p_other"))


def committed(spark: SparkSession, sink: str, manifest: str) -> DataFrame | None:
    """The rows of finished files: of each file those of the first run that has committed it. None before the first commit."""
    done, rows = stored_table(spark, manifest), stored_table(spark, sink)
    if done is None or rows is None:
        return None
    first = done.groupBy("raw_file").agg(F.min_by("run", F.struct("at", "run")).alias("run"))
    return rows.join(first, ["raw_file", "run"], "left_semi").drop("run")


def commit_files(files: DataFrame, sink: str, manifest: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Writes work(files) of those files that the manifest does not have under a run of its own, then names them in the manifest.

    A run that dies before its manifest rows are written leaves rows that nobody reads; its files are
    worked on again. Two runs over one file at a time both end, and readers take the first commit.
    """
    spark, run = files.sparkSession, uuid.uuid4().hex
    done = stored_table(spark, manifest)
    left = files.dropDuplicates(["raw_file"])
    left = left if done is None else left.join(done.select("raw_file").distinct(), "raw_file", "left_anti")
    if left.isEmpty():
        return
    work(left).withColumn("run", F.lit(run)).write.mode("append").parquet(sink)
    left.select("raw_file", F.lit(run).alias("run"), F.current_timestamp().alias("at")).write.mode("append").parquet(manifest)


def predict_new_files(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str, manifest: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> None:
    """Streams the announcements (raw_file, n_pings, n_range, ...) that come to the folder `source` and commits work(announced files), batch by batch, until none is left."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).writeStream
    stream = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    stream.foreachBatch(lambda batch, _: commit_files(batch, sink, manifest, work)).start().awaitTermination()
