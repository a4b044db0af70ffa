"""Operator 13: vector compression to one byte for each of eight parts, with memoised grid cells.

Method. Components become integers, floor(4096 * x). Vectors are cut into `PARTS` equal parts,
each with a codebook of at most `ENTRIES` entries, which `ROUNDS` rounds of assignment and
floored means refine, all in integers. To assign a part, its coarse cell (each component
shifted right by `SHIFT`) is looked up in a memo. A cell that is not there is judged once: an
entry is dominated if the smallest difference, across the cell's box, of its squared distance
to that of another entry is positive (the difference is linear, so that is exact; to compare
the smallest distance of one with the largest of another would keep nearly all entries of an
eight-component box). The others are kept in the memo. Only these are evaluated exactly, ties
to the lower index, so the result is that of evaluating all. Wide cells are met again more
often and narrow ones exclude more; at 1024, two standard deviations of the given vectors,
about three quarters of the entries are left to evaluate.

Scale. Every round is one pass over the written integer vectors. A task sends sums and counts
by part, entry and component, which are added up before and after one small shuffle; only the
codebooks (16 times the length of a vector) pass through the driver. A memo belongs to a task
and a round and starts anew beyond `MEMO` cells. Errors of a label are added up before they
are joined to its vectors. No step gathers the vectors of a label or a cell.

Edge cases. Rows whose vector is null or holds a null or non-finite component are dropped. The
codebooks start from the 16 smallest kept vec_ids; rows that share one stand in the order of
their vectors, null vec_ids last. Fewer than 16 vectors give as many entries. Vectors are as
long as the first one, by vec_id, whose length is a positive multiple of 8; kept vectors of
another length stay, without code and error, and count nowhere. Equal rows are rows of their
own. A component of 32768 or more has squared distances beyond 64 bits and is an error. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A cell is 2**SHIFT wide in each component; cells in a memo; largest component after scaling.
SHIFT, MEMO, LIMIT = 10, 1 << 16, 1 << 27
#: Cells judged at a time.
JUDGED = 256


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, embedding -> vec_id, label, v of the rows whose components are all there and finite."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("embedding")))
        at = np.r_[0, np.cumsum(pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False))].astype(np.int64)
        x = batch.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        bad = np.r_[0, np.cumsum(~np.isfinite(x))]
        keep = bad[at[1:]] == bad[at[:-1]]
        x = x[np.repeat(keep, np.diff(at))]
        if len(x) and np.abs(x).max() * SCALE >= LIMIT:
            raise ValueError(f"components of {LIMIT // SCALE} or more cannot be compared in 64 bits")
        v = np.floor(SCALE * x).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.diff(at)[keep])].astype(np.int32)), pa.array(v))
        held = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([held.column("vec_id"), held.column("label"), lists], ["vec_id", "label", "v"])


class Memo:
    """The entries of one part's codebook that may be nearest, by cell."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.cells: dict[bytes, np.ndarray] = {}

    def judge(self, cells: np.ndarray) -> np.ndarray:
        """For each cell, which entries are not dominated across its box."""
        c, out = self.entries, []
        apart, norms = c[:, None] - c[None], (c * c).sum(axis=1)
        for k in range(0, len(cells), JUDGED):
            low = cells[k : k + JUDGED, None, None, :].astype(np.int64) << SHIFT
            high = low + (1 << SHIFT) - 1
            least = norms[:, None] - norms[None] - 2 * np.maximum(low * apart, high * apart).sum(axis=3)
            out.append(~(least > 0).any(axis=2))
        return np.concatenate(out)

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """For each row of x, which entries may be nearest."""
        cells = np.ascontiguousarray((x >> SHIFT).astype(np.int32))
        names = cells.view(np.dtype((np.void, cells.strides[0]))).ravel()
        _, first, which = np.unique(names, return_index=True, return_inverse=True)
        keys = [names[i].tobytes() for i in first.tolist()]
        if len(self.cells) > MEMO:
            self.cells.clear()
        new = [i for i, key in enumerate(keys) if key not in self.cells]
        if new:
            for i, row in zip(new, self.judge(cells[first[new]]), strict=True):
                self.cells[keys[i]] = row
        return np.stack([self.cells[key] for key in keys])[which]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, ties to the lower index, and its squared distance."""
        may = self.candidates(x)
        row, entry = np.nonzero(may)
        diff = x[row] - self.entries[entry]
        distance = (diff * diff).sum(axis=1)
        count = may.sum(axis=1)
        least = np.minimum.reduceat(distance, np.cumsum(count) - count)
        hit = np.flatnonzero(distance == np.repeat(least, count))
        first = np.r_[True, row[hit][1:] != row[hit][:-1]]
        return entry[hit[first]], least


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as an array (row, part, component)."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, PARTS, -1)


def _sums(books: np.ndarray):
    """v -> part, entry, place, total, n: sums by component and counts of the parts that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(book) for book in books]
        total, n = np.zeros(books.shape, dtype=np.int64), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _parts(batch)
                for p, memo in enumerate(memos):
                    entry, _ = memo.assign(x[:, p])
                    np.add.at(total[p], entry, x[:, p])
                    n[p] += np.bincount(entry, minlength=books.shape[1])
        part, entry, place = np.nonzero(np.repeat(n[:, :, None] > 0, books.shape[2], axis=2))
        columns = [part, entry, place, total[part, entry, place], n[part, entry]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "place", "total", "n"])

    return run


def _codes(books: np.ndarray):
    """vec_id, label, v -> vec_id, label, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(book) for book in books]
        for batch in batches:
            codes, error = [], np.zeros(batch.num_rows, dtype=np.int64)
            if batch.num_rows:
                x, own = _parts(batch), np.empty((batch.num_rows, PARTS), dtype=np.uint8)
                for p, memo in enumerate(memos):
                    own[:, p], distance = memo.assign(x[:, p])
                    error += distance
                codes = [row.tobytes().hex() for row in own]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def trained(vectors: DataFrame, length: int) -> np.ndarray:
    """Codebooks (part, entry, component) of vectors(vec_id, v), all of one length."""
    seeds = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    books = np.array([s.v for s in seeds], dtype=np.int64).reshape(len(seeds), PARTS, length // PARTS).swapaxes(0, 1).copy()
    for _ in range(ROUNDS):
        found = vectors.select("v").mapInArrow(_sums(books), "part long, entry long, place long, total long, n long")
        found = found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        part, entry, place, total, n = (found.column(c).to_numpy() for c in ("part", "entry", "place", "total", "n"))
        books[part, entry, place] = total // n
    return books


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """vectors(vec_id, embedding, label) -> (vec_id, label, code, error of each kept row; codebooks)."""
    ws = Workspace(vectors.sparkSession, "codes")
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, v array<bigint>"
    kept = ws.write(vectors.select("vec_id", "label", "embedding").mapInArrow(_integers, schema), "integers")
    first = kept.filter(f"size(v) > 0 and size(v) % {PARTS} = 0").orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    length = len(first[0].v) if first else 0
    if not length:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((PARTS, 0, 0), dtype=np.int64)
    fit = kept.filter(F.size("v") == length)
    books = trained(fit, length)
    coded = fit.mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long")
    other = kept.filter(F.size("v") != length).select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long"))
    return ws.write(coded.union(other), "codes"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    labels = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES = {"op13_vector_codes": op13_vector_codes}


def _oracle() -> str:
    """All distances to all entries in every round, one pair of expressions for each round."""
    steps = [
        """
kept AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS MATERIALIZED (
  SELECT vec_id, ((i - 1) // (len(embedding) // 8))::INT AS part, ((i - 1) % (len(embedding) // 8))::INT AS place,
         floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM kept, unnest(range(1, len(embedding) + 1)) AS t(i)),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (SELECT part, entry, place, x AS c FROM cells JOIN seeds USING (vec_id))"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""
d{k} AS (SELECT vec_id, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM cells JOIN c{k} USING (part, place) GROUP BY 1, 2, 3),
a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k} GROUP BY 1, 2)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""
m{k} AS (SELECT part, entry, place, floor(sum(x)::HUGEINT / count(*))::BIGINT AS c FROM cells JOIN a{k} USING (vec_id, part) GROUP BY 1, 2, 3),
c{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, o.place, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} n USING (part, entry, place))"""
            )
    return (
        "WITH "
        + ",".join(steps)
        + f""",
codes AS (SELECT vec_id, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (vec_id), digest
"""
    )


#: Holds where vec_ids are unique and vectors equally long, as in the given tables.
ORACLE = {"op13_vector_codes": _oracle()}
