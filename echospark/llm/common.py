"""Shared helpers of the training-data operators: tables, written steps, graph components, samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch between Spark and Python, and bytes of text that a task works on at a time.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 1_000, 4 << 20, 1 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, which bounds the memory of executors and Python workers."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))
    spark.conf.set(_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where it is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """Written intermediate tables of one operator call. A lost executor never costs more than the running step."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that write() returned and that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        gone = {id(df) for df in tables}
        for df, path in self.paths:
            if id(df) in gone:
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)
        self.paths = [(df, path) for df, path in self.paths if id(df) not in gone]


def fresh(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Slots of a bit set: its size, 2 MB, does not depend on the data.
BITS = 24


def slot_of(*keys: str | Column) -> Column:
    """A slot of a bit set for a key; equal keys, nulls included, have equal slots."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << BITS)).cast("int")


def bit_set(slots: DataFrame) -> np.ndarray:
    """The slots of a one-column DataFrame as packed bits. At most 2**18 words reach the driver, whatever the input."""
    s = F.col(slots.columns[0])
    words = slots.groupBy(F.shiftright(s, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {slots.columns[0]} & 63)")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def in_bit_set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def by_bit_set(df: DataFrame, column: str, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose `column` has its slot in a bit set, and the others; neither is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(bits)
    names, slot = df.columns, fresh("__slot", df)

    def part(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 2048):
                own = in_bit_set(shared.value, batch.column(len(names)).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(own == wanted))

        return df.select(*df.columns, slot_of(column).alias(slot)).mapInArrow(run, df.schema)

    return part(True), part(False)


def may_match(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose `column` may be among the first column of ids, by a bit set; no row that is among them is lost."""
    return by_bit_set(df, column, bit_set(ids.select(slot_of(ids.columns[0]).alias("slot"))))[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` and, if there is a column `text`, about SLICE_BYTES of it."""
    for batch in batches:
        n, lo = batch.num_rows, 0
        texts = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy() if "text" in batch.schema.names else np.zeros(n)
        ends = np.cumsum(texts, dtype=np.int64)
        while lo < n:
            full = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, side="right"))
            hi = max(lo + 1, min(lo + rows, full))
            yield batch.slice(lo, hi - lo)
            lo = hi
        # workers are kept for later tasks; what this batch no longer needs goes back
        pa.default_memory_pool().release_unused()


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (node, label) per node that has an edge.

    label is the smallest node of the component. Each round takes the smallest label
    among neighbours and then jumps to the label's own label, so long chains halve.
    Rounds are written tables; no row of them passes through the driver.
    """
    both = ws.write(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "arcs"
    )
    labels = ws.write(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        new = ws.write(
            step.join(up, "mid", "left").select("node", F.least("mid", F.coalesce("top", "mid")).alias("label"), "old"), "labels"
        )
        changed = new.filter("label <> old").limit(1).count()
        ws.drop(labels)
        labels = new
        if not changed:
            ws.drop(both)
            return labels


def bounded_sample(ws: Workspace, df: DataFrame, by: str, key: str, cap: int, salt: str = "sample") -> DataFrame:
    """About `cap` rows of each value of `by`, chosen by a hash of `key` and `salt` alone.

    All rows are counted; a group of n rows keeps those whose hash lies in the first
    cap / n of its range. The counts, one row per value of `by`, are a written table, so
    Spark knows their size: while they are few it broadcasts them and df is filtered where
    it is read, else both sides are joined on `by`.
    """
    value, count = fresh("__by", df), fresh("__n", df)
    sizes = ws.write(df.groupBy(F.col(by).alias(value)).agg(F.count("*").alias(count)), "sizes")
    ranked = df.join(sizes, F.col(by).eqNullSafe(F.col(value)))
    share = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return ranked.filter(share < F.lit(float(cap)) / F.col(count)).select(*df.columns)


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as decimal text, modulo."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
