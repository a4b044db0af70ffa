"""Operator 12: near-duplicate documents by SimHash fingerprints of 64 bits.

Method. A bit of a text's fingerprint is 1 if it is set in over half the XXH64 hashes of its
k-word shingles, repeats included. Two fingerprints are linked if `DISTANCE` = 3 bits or fewer
differ. Then 3 of their 8 bytes differ at most, so 5 positional bytes or more are shared: that
is the guaranteed minimum of matches. Fingerprints are filed in an inverted index by positional
bytes. The posting list of a single byte would hold a 256th of all fingerprints, so lists are
intersected beforehand, three positions at a time: of any five positions, three are among the
first four or among the last four, so the four triples of each half, eight lists for each
fingerprint, hold every pair that shares five. Within a list the shared positional bytes of
each pair are tallied, pairs that reach five are retained, and these are verified by their
differing bits.

Scale. Equal fingerprints are one class from the start. A list of any length is dealt into
blocks of at most about `BLOCK` fingerprints by a hash, and every pair of blocks is a row of its
own; the size of a list is aggregated before it is gathered. A task reports which of its
fingerprints hang together (a star for each group), not their pairs, so copies are never
expanded into all pairs, and no link between components is lost. Rows of a frequent
fingerprint or component are joined from written tables, which adaptive execution can split.

Edge cases. A null, empty or blank text has the fingerprint zero and is linked like any other.
A text of fewer than k words is one shingle. Rows that repeat a doc_id are rows of their own. A
null doc_id takes part; its component is the smallest id reached, or null if there is none. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, components, slices, table

SEED, DISTANCE, BYTES = 42, 3, 8
SHARED = BYTES - DISTANCE
#: Fingerprints in a block of a posting list, columns of a tile of a pair of blocks, and the length up to which lists are taken together.
BLOCK, TILE, SHORT = 4096, 256, 8
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 14
#: The positions of the eight posting lists that hold a fingerprint, as bit masks of its bytes.
MASKS = [sum(0xFF << (8 * p) for p in positions) for half in (range(4), range(4, 8)) for positions in combinations(half, 3)]


def fingerprint(text: bytes, k: int = 3) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]].tolist()
    last = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[i : i + COUNTED].astype("<u8").view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [fingerprint(t.as_buffer().to_pybytes(), k) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.int64())], ["doc_id", "fp"])

    return run


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs x[i], y[i] share the minimum of positional bytes and then differ in few enough bits."""
    differ = x ^ y
    tally = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    return (tally >= SHARED) & (np.bitwise_count(differ) <= DISTANCE)


def _tile(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of all of x with all of y, by their places."""
    bx, by = x.view(np.uint8).reshape(-1, BYTES), y.view(np.uint8).reshape(-1, BYTES)
    tally = np.zeros((len(x), len(y)), dtype=np.uint8)
    for p in range(BYTES):
        tally += bx[:, p, None] == by[None, :, p]
    i, j = np.nonzero(tally >= SHARED)
    near = np.bitwise_count(x[i] ^ y[j]) <= DISTANCE
    return i[near], j[near]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each node's smallest known companion) after the links i, j."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


def held_together(x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold together what links among x, or between x and y, hold together: each node with the first of its group."""
    both, base = (x, 0) if y is None else (np.concatenate([x, y]), len(x))
    other, label = both[base:], np.arange(len(both))
    for lo in range(0, len(other), TILE):
        # among x, only what stands before the end of the tile
        i, j = _tile(x[: lo + TILE] if y is None else x, other[lo : lo + TILE])
        label = _merge(label, i, j + base + lo)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return both[moved], both[label[moved]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """xs, ys (null: xs with itself) -> a, b that hang together."""
    for batch in batches:
        xs, ys, out = batch.column("xs"), batch.column("ys"), []
        at = xs.offsets.to_numpy().astype(np.int64)
        flat = xs.values.to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.diff(at)
        short = (size <= SHORT) & ys.is_null().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.where(short, np.arange(len(size)), -1), size)
        whole = flat[at[0] : at[-1]]
        for shift in range(1, SHORT):
            i = np.flatnonzero((owner[shift:] == owner[:-shift]) & (owner[shift:] >= 0))
            i = i[_linked(whole[i], whole[i + shift])]
            out.append((whole[i], whole[i + shift]))
        for k in np.flatnonzero(~short).tolist():
            other = ys[k].values.to_numpy(zero_copy_only=False).view(np.uint64) if ys[k].is_valid else None
            out.append(held_together(flat[at[k] : at[k + 1]], other))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[s] for p in out]).view(np.int64)) for s in (0, 1)], ["a", "b"])


def links(ws: Workspace, classes: DataFrame) -> DataFrame:
    """a, b: pairs of the distinct fingerprints of classes(fp) that hold every component of linked ones together."""
    lists = F.posexplode(F.array(*[F.expr(f"fp & {m if m < 1 << 63 else m - (1 << 64)}L") for m in MASKS])).alias("list", "key")
    postings = classes.select("fp", lists)
    sizes = postings.groupBy("list", "key").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = ws.write(sizes.select("list", "key", F.ceil(F.col("size") / F.lit(float(BLOCK))).cast("long").alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block")
    dealt = postings.join(sizes, ["list", "key"]).select("list", "key", "blocks", block, "fp")
    dealt = ws.write(dealt.groupBy("list", "key", "blocks", "block").agg(F.collect_list("fp").alias("fps")), "blocks")
    none = F.lit(None).cast("array<long>").alias("ys")
    rows = dealt.filter("size(fps) > 1").select(F.col("fps").alias("xs"), none)
    many = dealt.filter("blocks > 1").select("list", "key", "block", "fps")
    if many.limit(1).count():
        x, y = (many.select("list", "key", F.col("block").alias(f"block_{s}"), F.col("fps").alias(s)) for s in ("xs", "ys"))
        rows = rows.union(x.join(y, ["list", "key"]).filter("block_xs < block_ys").select("xs", "ys"))
    return ws.write(rows.mapInArrow(_groups, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, k: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 lowercase hex digits), component_id: one row per document."""
    ws = Workspace(docs.sparkSession, "simhash")
    rows = ws.write(docs.select("doc_id", "text").mapInArrow(_fingerprints(k), "doc_id long, fp long"), "fingerprints")
    classes = ws.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    labels = components(ws, links(ws, classes))
    grouped = ws.write(labels.join(classes, labels.node == classes.fp).select("fp", "label", "least"), "grouped")
    heads = ws.write(grouped.groupBy("label").agg(F.min("least").alias("head")), "heads")
    own = F.coalesce("head", "least").alias("component_id")
    grouped = grouped.join(heads, "label").select("fp", "head")
    named = ws.write(classes.join(grouped, "fp", "left").select("fp", own), "named")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", digits, "component_id")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_simhash_near_dedup": op12_simhash_near_dedup}


#: The five primes of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_WORD = 1 << 64


def _xxh64_sql(source: str, column: str, seed: int) -> str:
    """Expressions for DuckDB that end in xx(column, h): XXH64 of the distinct texts of a source, in arithmetic of 128 bits modulo 2**64."""
    p1, p2, p3, p4, p5 = _PRIMES
    mul = lambda a, b: f"(({a})::UHUGEINT * ({b})::UHUGEINT % {_WORD}::UHUGEINT)::UBIGINT"  # noqa: E731
    add = lambda *x: "((" + " + ".join(f"({v})::UHUGEINT" for v in x) + f") % {_WORD}::UHUGEINT)::UBIGINT"  # noqa: E731
    turn = lambda x, r: f"((({x})::UHUGEINT * {1 << r}::UHUGEINT % {_WORD}::UHUGEINT)::UBIGINT | (({x}) >> {64 - r}))"  # noqa: E731
    lane = lambda acc, v: mul(turn(add(acc, mul(v, p2)), 31), p1)  # noqa: E731
    # little-endian numbers out of the hexadecimal digits of the bytes
    number = lambda at, size: "('0x' || " + " || ".join(f"substr(hx, 2 * ({at} + {k}) + 1, 2)" for k in range(size - 1, -1, -1)) + ")::UBIGINT"  # noqa: E731
    each = lambda count, value, step, start: f"list_reduce(list_transform(range({count}), lambda j: {value}), lambda a, x: {step}, {start})"  # noqa: E731
    starts = [(seed + p1 + p2) % _WORD, (seed + p2) % _WORD, seed, (seed - p1) % _WORD]
    lanes = ", ".join(each("n // 32", number(f"32 * j + {8 * i}", 8), lane("a", "x"), f"{start}::UBIGINT") + f" AS v{i}" for i, start in enumerate(starts))
    eight = add(mul(turn(f"xor(a, {lane('0', 'x')})", 27), p1), p4)
    four = add(mul(turn(f"xor(h2, {mul(number('n // 8 * 8', 4), p1)})", 23), p2), p3)
    return f"""hx AS (SELECT DISTINCT {column}, hex(encode({column})) AS hx, octet_length(encode({column})) AS n FROM {source}),
lanes AS (SELECT *, {lanes} FROM hx),
m0 AS (SELECT *, CASE WHEN n >= 32 THEN {add(turn("v0", 1), turn("v1", 7), turn("v2", 12), turn("v3", 18))} ELSE {(seed + p5) % _WORD}::UBIGINT END AS h0 FROM lanes),
m1 AS (SELECT {column}, hx, n, CASE WHEN n >= 32 THEN list_reduce([v0, v1, v2, v3], lambda a, x: {add(mul(f"xor(a, {lane('0', 'x')})", p1), p4)}, h0) ELSE h0 END AS h1 FROM m0),
m2 AS (SELECT *, {each("n % 32 // 8", number("n // 32 * 32 + 8 * j", 8), eight, add("h1", "n"))} AS h2 FROM m1),
m3 AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {four} ELSE h2 END AS h3 FROM m2),
m4 AS (SELECT *, {each("n % 4", number("n // 4 * 4 + j", 1), mul(turn(f"xor(a, {mul('x', p5)})", 11), p1), "h3")} AS h4 FROM m3),
m5 AS (SELECT *, {mul("xor(h4, h4 >> 33)", p2)} AS h5 FROM m4),
m6 AS (SELECT *, {mul("xor(h5, h5 >> 29)", p3)} AS h6 FROM m5),
xx AS MATERIALIZED (SELECT {column}, xor(h6, h6 >> 32) AS h FROM m6)"""


_BITS = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))

#: All pairs of distinct fingerprints, then the components' least ids by label passing.
ORACLE = {
    "op12_simhash_near_dedup": rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS ws
  FROM documents),
s AS MATERIALIZED (SELECT row, array_to_string(ws[i:least(i + 2, len(ws))], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS t(i) WHERE len(ws) > 0),
{_xxh64_sql("s", "sh", SEED)},
f AS MATERIALIZED (SELECT row, ({_BITS})::UBIGINT AS fp FROM s JOIN xx USING (sh) GROUP BY row),
d AS MATERIALIZED (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM w LEFT JOIN f USING (row)),
c AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM d GROUP BY fp),
arcs AS MATERIALIZED (SELECT x.fp AS a, y.fp AS b FROM c x JOIN c y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= {DISTANCE}),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM arcs UNION SELECT r.node, arcs.b FROM reach r JOIN arcs ON r.seen = arcs.a),
comp AS (SELECT node, min(least) AS component_id FROM reach JOIN c ON c.fp = reach.seen GROUP BY node)
SELECT doc_id, lpad(lower(hex(d.fp)), 16, '0') AS fingerprint, coalesce(component_id, least) AS component_id
FROM d JOIN c USING (fp) LEFT JOIN comp ON comp.node = d.fp
"""
}
