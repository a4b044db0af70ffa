"""Raw float32 matrices (C order, range by ping) as a Spark data source, and their resumable ingest.

A manifest row describes one matrix: source (path below the root), raw_file, freq_hz, n_range,
n_pings, first_ping (of the raw file's pings, its first column). Matrices are read in parts of
whole pings: a part is n_range byte ranges of its file, so a file of any size is many tasks
and no task holds more than about a part. Files are opened with pyarrow's file systems (local and
shared folders, HDFS, object stores), never through the driver.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.objects import stored_at, written
from .tables import new_rows, stored_table

FORMAT = "echo_matrix"
#: Bytes of a part and of a task's parts.
PART_BYTES = 64 << 20
#: Pings of a part that are turned into rows at a time.
ROWS = 512
MANIFEST = "source string, raw_file string, freq_hz int, n_range int, n_pings int, first_ping long"
PARTS = MANIFEST + ", lo int, hi int"
SCHEMA = "raw_file string, freq_hz int, ping_idx long, sv array<double>, source string, lo int, reason string"


def _opened(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pfs.LocalFileSystem(), uri)


def _row(part: dict, reason: str | None, ping: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    n, width = len(ping), values.shape[1] if values.ndim == 2 else 0
    same = lambda v, kind: pa.array([v] * n, kind)
    columns = [
        same(part["raw_file"], pa.string()),
        same(part["freq_hz"], pa.int32()),
        pa.array(ping, pa.int64()),
        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel().astype(np.float64))),
        same(part["source"], pa.string()),
        same(part["lo"], pa.int32()),
        same(reason, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["raw_file", "freq_hz", "ping_idx", "sv", "source", "lo", "reason"])


def _part_rows(fs: pfs.FileSystem, root: str, part: dict) -> Iterator[pa.RecordBatch]:
    """The pings lo .. hi - 1 of a matrix; one row with a reason if they cannot be read."""
    n, m, lo, hi = part["n_range"], part["n_pings"], part["lo"], part["hi"]
    reason, rows = None, []
    try:
        info = fs.get_file_info(posixpath.join(root, part["source"]))
        if info.type != pfs.FileType.File:
            reason = "no file"
        elif info.size != 4 * n * m:
            reason = "size does not fit"
        else:
            with fs.open_input_file(info.path) as file:
                for r in range(n):
                    piece = file.read_at(4 * (hi - lo), 4 * (r * m + lo))
                    if len(piece) != 4 * (hi - lo):
                        raise OSError("the file ends early")
                    rows.append(np.frombuffer(piece, dtype="<f4"))
    except OSError as e:
        reason = f"not readable: {type(e).__name__}"
    if reason is not None:
        yield _row(part, reason, np.array([-1]), np.zeros((1, 0)))
        return
    data = np.stack(rows) if rows else np.zeros((0, hi - lo), "<f4")
    for k in range(0, hi - lo, ROWS):
        block = data[:, k : k + ROWS].T
        yield _row(part, None, part["first_ping"] + lo + k + np.arange(len(block)), block)


class _Parts(InputPartition):
    """Parts that one task reads."""

    def __init__(self, parts: list[dict]) -> None:
        self.parts = parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.parts, self.limit = options["path"], options["parts"], int(options.get("task_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Parts in the order of their files, together up to the bytes of a task; only their descriptions are read here."""
        fs, folder = _opened(self.parts)
        files = [i.path for i in fs.get_file_info(pfs.FileSelector(folder)) if i.type == pfs.FileType.File and i.base_name.endswith(".json")]
        parts = [json.loads(line) for name in sorted(files) for line in fs.open_input_stream(name).read().decode().splitlines()]
        out, size = [[]], 0
        for part in sorted(parts, key=lambda p: (p["source"], p["lo"])):
            own = 4 * part["n_range"] * (part["hi"] - part["lo"])
            if out[-1] and size + own > self.limit:
                out.append([])
                size = 0
            out[-1].append(part)
            size += own
        return [_Parts(p) for p in out if p]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        """Rows of a task's parts; Spark gives None where there are no partitions."""
        fs, root = _opened(self.root)
        for part in partition.parts if partition is not None else []:
            yield from _part_rows(fs, root, part)


@dataclass
class _Written(WriterCommitMessage):
    manifest: str


class _Writer(DataSourceArrowWriter):
    """Rows raw_file, freq_hz, piece, ping_idx, sv, whole pieces in the order of their pings -> one matrix each, and a part of the manifest."""

    def __init__(self, options: dict) -> None:
        self.root = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _opened(self.root)
        lines, key, first, rows = [], None, 0, []

        def close() -> None:
            if key is None:
                return
            name, (data, freq) = f"{key[0]}/{key[1]}/{key[2]:08d}.dat", (np.stack(rows, axis=1).astype("<f4"), key[1])
            fs.create_dir(posixpath.dirname(posixpath.join(root, name)), recursive=True)
            with fs.open_output_stream(posixpath.join(root, name)) as file:
                file.write(np.ascontiguousarray(data).tobytes())
            lines.append(json.dumps({"source": name, "raw_file": key[0], "freq_hz": freq, "n_range": data.shape[0], "n_pings": data.shape[1], "first_ping": first}))

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("raw_file", "freq_hz", "piece", "ping_idx")]
            for own, sv in zip(zip(*cols, strict=True), batch.column("sv"), strict=True):
                if own[:3] != key:
                    close()
                    key, first, rows = own[:3], own[3], []
                rows.append(sv.values.to_numpy(zero_copy_only=False))
        close()
        name = ""
        if lines:
            fs.create_dir(posixpath.join(root, "manifest"), recursive=True)
            name = f"manifest/part-{uuid.uuid4().hex}"
            with fs.open_output_stream(posixpath.join(root, name)) as file:
                file.write("\n".join(lines).encode())
        return _Written(name)

    def commit(self, messages: list) -> None:
        """A part of the manifest counts once it ends in .json; those of failed attempts never do."""
        fs, root = _opened(self.root)
        for m in messages:
            if m is not None and m.manifest:
                fs.move(posixpath.join(root, m.manifest), posixpath.join(root, m.manifest + ".json"))

    def abort(self, messages: list) -> None:
        fs, root = _opened(self.root)
        for m in messages:
            if m is not None and m.manifest:
                fs.delete_file(posixpath.join(root, m.manifest))


class MatrixSource(DataSource):
    """spark.read.format("echo_matrix"): options path, parts, task_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


def write_matrices(sv: DataFrame, path: str, pings: int = 4096) -> DataFrame:
    """Writes sv(raw_file, freq_hz, ping_idx, sv) as matrices of at most `pings` pings below path; returns their manifest.

    All profiles of a piece have one length. Pieces are dealt to tasks by a shuffle; a task holds one at a time.
    """
    spark = sv.sparkSession
    spark.dataSource.register(MatrixSource)
    rows = sv.select("raw_file", F.col("freq_hz").cast("int"), F.floor(F.col("ping_idx") / pings).cast("int").alias("piece"), F.col("ping_idx").cast("long"), F.col("sv").cast("array<double>"))
    rows = rows.repartition("raw_file", "freq_hz", "piece").sortWithinPartitions("raw_file", "freq_hz", "piece", "ping_idx")
    rows.write.format(FORMAT).mode("append").save(path)
    return spark.read.schema(MANIFEST).option("pathGlobFilter", "*.json").json(f"{path}/manifest")


def parts_of(manifest: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """manifest with lo, hi: ranges of pings of about part_bytes; an empty or impossible matrix is one part."""
    step = F.greatest(F.lit(1), F.floor(F.lit(part_bytes) / (4 * F.greatest(F.col("n_range"), F.lit(1)))).cast("int"))
    named = manifest.select("source", "raw_file", "freq_hz", "n_range", "n_pings", F.coalesce("first_ping", F.lit(0)).alias("first_ping"))
    out = named.withColumn("lo", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_pings") - 1, F.lit(0)), step)))
    return out.withColumn("hi", F.least(F.col("lo") + step, F.col("n_pings")).cast("int"))


def read_matrices(spark: SparkSession, path: str, parts: DataFrame, task_bytes: int = PART_BYTES) -> DataFrame:
    """Profiles of parts(parts_of): raw_file, freq_hz, ping_idx, sv, source, lo, reason (null where the part is sound)."""
    spark.dataSource.register(MatrixSource)
    folder = stored_at(parts.select(*[c.split()[0] for c in PARTS.split(", ")]), "json")
    return spark.read.format(FORMAT).option("parts", folder).option("task_bytes", task_bytes).load(path)


def ingest(spark: SparkSession, path: str, manifest: DataFrame, target: str, quarantine: str, part_bytes: int = PART_BYTES) -> None:
    """Adds the matrices of manifest to the table at `target`, part by part; parts that cannot be read go to `quarantine`.

    Parts that target has are not read again, so a run after a failure does what is left; parts in
    quarantine are tried again and leave it for target once they are sound.
    """
    parts = parts_of(manifest, part_bytes)
    left = written(new_rows(parts, stored_table(spark, target), ["source", "lo"]))
    if left.isEmpty():
        return
    rows = read_matrices(spark, path, left)
    rows.filter("reason is null").drop("reason").write.mode("append").parquet(target)
    # what a part gave stands in the table now; parts without a row there could not be read, and are looked at once more for the reason
    bad = written(new_rows(left, stored_table(spark, target), ["source", "lo"]))
    told = read_matrices(spark, path, bad).filter("reason is not null")
    told.select("source", "raw_file", "freq_hz", "lo", "reason").write.mode("overwrite").parquet(quarantine)
