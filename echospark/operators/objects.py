"""Fish-school objects: connected components of label maps and summaries of object tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stored_at(df: DataFrame, format: str = "parquet") -> str:
    """Writes df to a new folder in the shared folder of spark.checkpoint.dir, and returns the folder.

    A temporary folder serves where the setting is missing and Spark runs in one process.
    """
    path = _new_folder(df.sparkSession)
    df.write.format(format).save(path)
    return path


def _new_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/objects-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that rounds have no lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_at(df))


def written_in_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df as a table in the shared folder, in buckets of its keys: joins and groups by these keys do not shuffle it.

    Give df in `buckets` partitions of the keys, so that each bucket is one file.
    """
    name = f"buckets_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", _new_folder(df.sparkSession)).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that `written` returned and that nothing reads any more."""
    jvm = table.sparkSession._jvm
    conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if folder.rpartition("/")[2].startswith("objects-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def runs(labels: DataFrame, skip: tuple[int, ...] = (0, -100)) -> DataFrame:
    """labels(raw_file, ping_idx, labels) -> maximal runs along range: raw_file, ping_idx, category, lo, hi (inclusive)."""
    cells = labels.select("raw_file", "ping_idx", F.posexplode("labels").alias("r", "category")).filter(~F.col("category").isin(list(skip)))
    order = Window.partitionBy("raw_file", "ping_idx", "category").orderBy("r")
    grouped = cells.withColumn("__g", F.col("r") - F.row_number().over(order))
    return grouped.groupBy("raw_file", "ping_idx", "category", "__g").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).drop("__g")


def label_objects(labels: DataFrame, skip: tuple[int, ...] = (0, -100)) -> DataFrame:
    """4-connected components per category of label maps, all files at once.

    raw_file, object_id, category, n_pixels, y0, y1, x0, x1 (inclusive), labeled_as_segmentation.
    Runs of neighbouring pings that overlap in range are linked; the smallest run id is passed
    along links with pointer jumping until nothing changes.
    """
    nodes = written(runs(labels, skip).withColumn("id", F.monotonically_increasing_id()))
    nxt = nodes.select("raw_file", "category", (F.col("ping_idx") - 1).alias("ping_idx"), F.col("id").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    links = nodes.join(nxt, ["raw_file", "category", "ping_idx"]).filter("lo <= hi2 and lo2 <= hi").select(F.col("id").alias("a"), "b")
    arcs = written(links.union(links.select("b", "a")))
    state = written(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = arcs.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = state.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        up = state.select(F.col("id").alias("mid"), F.col("label").alias("top"))
        new = written(step.join(up, "mid").select("id", "old", F.least("mid", "top").alias("label")))
        removed(state)
        state = new.select("id", "label")
        if new.filter("label <> old").isEmpty():
            removed(arcs)
            break
    out = nodes.join(state.select("id", "label"), "id").groupBy("raw_file", "category", "label").agg(
        F.sum(F.col("hi") - F.col("lo") + 1).alias("n_pixels"), F.min("lo").alias("y0"), F.max("hi").alias("y1"), F.min("ping_idx").alias("x0"), F.max("ping_idx").alias("x1")
    )
    area = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    return out.withColumnRenamed("label", "object_id").withColumn("labeled_as_segmentation", area != F.col("n_pixels"))


def objects_by_species(objects: DataFrame) -> DataFrame:
    """raw_file, category, objects[(object_id, box)]: ids and boxes grouped by species."""
    item = F.struct("object_id", F.struct("y0", "y1", "x0", "x1").alias("box"))
    return objects.groupBy("raw_file", "category").agg(F.sort_array(F.collect_list(item)).alias("objects"))


def dominant_species(fractions: DataFrame) -> DataFrame:
    """fractions(object_id, channel, species, fraction, rank) -> species with the largest fraction, the first of equals."""
    return fractions.groupBy("object_id").agg(F.min_by("species", F.struct(-F.col("fraction"), F.col("rank"))).alias("species"))


def duplicated_ids(objects: DataFrame) -> DataFrame:
    """object ids that stand in more than one row of a survey."""
    return objects.groupBy("survey", "object_id").agg(F.count("*").alias("n")).filter("n > 1")
