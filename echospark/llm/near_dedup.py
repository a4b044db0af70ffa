"""Operator 8: near-duplicate documents by HyperMinHash.

Method. A text is the set of its distinct k-word shingles. One 64-bit hash per
shingle: the top 7 bits choose one of 128 registers, which keeps the smallest
remainder as (leading zeros, mantissa) in 16 bits. Four neighbouring registers make
one of 32 bands; documents that agree in a non-empty band are candidates. The
collision-corrected Jaccard estimate of the compressed registers drops clear
non-matches, as do 16-bit prints of the shingles where both sets are short (they only
overstate what is common). Every remaining pair is verified on full shingle sets.

Scale. Texts with equal sets are one class from the start. In a band bucket every
class is paired with the smallest one, and the verified links give first components.
In buckets whose classes are not all connected yet, the classes outside the largest
component are compared in blocks of bounded size with all classes that are still apart;
a comparison names a class and the component that it may reach, not pairs of classes.
A bucket is compared by overlapping ranges of the size of a set, as sets whose sizes are too far apart
cannot be linked; a range without another component within reach of a class is closed.
Each class is then verified against the largest component that it may reach, and, with
the components merged, against what is still apart. So no link between components is
lost, and copies are never expanded into all pairs. Only buckets of several classes
leave the first step; sets are made again for the classes in question alone, whose
documents a bit set of fixed size picks, so no text is shuffled for that. What joins
on a key that may be hot (a bucket, a component, a set of copies) is a written table on
both sides, which adaptive execution can split.

Edge cases. Null, empty or blank texts have an empty set: n_shingles 0, linked with
nothing, component_id is their own id, and all of them are kept. A text of fewer than k
words is one shingle. Rows that repeat a doc_id are rows of their own. A null doc_id takes
part; its component is the smallest id reached, or null. Other columns are ignored.
drop_near_duplicates keeps exactly one row of each component: of the rows with its
smallest id those of the smallest set, and one of rows that are equal in both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import Workspace, bit_set, by_bit_set, components, fresh, may_match, slices, slot_of, table

REGISTERS, MANTISSA, BANDS = 128, 10, 32
#: Classes in a block of a bucket, and in a block of those outside its largest component.
BLOCK, OUTER = 1024, 256
#: Bytes of shingle sets in a block of a component.
BLOCK_BYTES = 1 << 20
#: Standard errors of the estimate that a pair may lie below the threshold and still be verified.
MARGIN = 5.0
#: Sets of at most so many shingles carry a 16-bit print of each, which bounds what two of them have in common from above.
PRINTS = 256


def shingle_sets(at: np.ndarray, raw: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles."""
    words, hashes = K.word_hashes(at, raw, K.BLANK_LOWER)
    runs = K.windows(hashes, k)
    for i in range(len(words) - 1):
        lo, hi = words[i], words[i + 1]
        if hi - lo >= k:
            yield np.unique(runs[lo : hi - k + 1])
        elif hi > lo:
            yield K.windows(hashes[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, dtype=np.uint64)


def registers(values: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits of a sorted set; 0 is an empty register.

    Six bits hold 1 + the leading zeros of the smallest remainder, ten its mantissa.
    """
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if len(values) == 0:
        return out
    bucket = (values >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low = (values[first] & np.uint64((1 << 57) - 1)).astype(np.uint64)
    # float conversion rounds, so find the exponent from the exact top bits
    exponent = np.frexp((low >> np.uint64(4)).astype(np.float64))[1]  # bits used of 53
    zeros = 53 - exponent
    shift = np.maximum(exponent - 1 + 4 - MANTISSA, 0).astype(np.uint64)
    mantissa = (low >> shift) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first]] = ((np.minimum(zeros + 1, 63).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected registers that agree by chance for disjoint sets of n and m elements.

    Sums, over the cells a register can hold, the product of both sets' chances of
    having their minimum there. Within one leading-zero level the mantissa cells are
    taken as equally likely, which errs by less than the mantissa's resolution.
    """
    a, b = np.asarray(n, float) / REGISTERS, np.asarray(m, float) / REGISTERS
    level = np.exp2(-np.arange(0, 45, dtype=float))
    hi, lo = level[:-1], level[1:]
    pa_ = np.exp(-np.outer(a, lo)) - np.exp(-np.outer(a, hi))
    pb = np.exp(-np.outer(b, lo)) - np.exp(-np.outer(b, hi))
    return REGISTERS * (pa_ * pb).sum(axis=1) / (1 << MANTISSA)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of register rows and the registers that are used by either."""
    used = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    return np.clip((same - expected_collisions(n, m)) / np.maximum(used, 1), 0, 1), used


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, raw = K.buffers(batch.column("text"))
            n, d1, d2, sig, prints = [], [], [], [], []
            for s in shingle_sets(at, raw, k):
                n.append(len(s))
                prints.append(s.astype(np.uint16).tobytes() if len(s) <= PRINTS else b"")
                a, b = K.set_digest(s)
                d1.append(a)
                d2.append(b)
                sig.append(registers(s).view(np.int64))
            flat = np.concatenate(sig) if sig else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists, pa.array(prints, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "sig", "prints"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, raw = K.buffers(batch.column("text"))
            n, d1, d2, body = [], [], [], []
            for s in shingle_sets(at, raw, k):
                n.append(len(s))
                a, b = K.set_digest(s)
                d1.append(a)
                d2.append(b)
                body.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(body, pa.binary())],
                ["n", "d1", "d2", "elements"],
            )

    return run


def _room(x: pa.Scalar, ys: pa.Array, n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether the prints of one set and of others leave room for the threshold; sets without prints always do."""
    out, own = np.ones(len(ys), dtype=bool), x.as_buffer()
    size = pc.binary_length(ys).to_numpy(zero_copy_only=False) // 2
    with_prints = np.flatnonzero(size > 0)
    if own is None or not own.size or not len(with_prints):
        return out
    mark = np.zeros(1 << 16, dtype=bool)
    mark[np.frombuffer(own, dtype=np.uint16)] = True
    flat = np.concatenate([np.frombuffer(ys[int(i)].as_buffer(), dtype=np.uint16) for i in with_prints])
    at = np.r_[0, np.cumsum(size[with_prints])[:-1]]
    common = np.minimum(np.add.reduceat(mark[flat], at, dtype=np.int64), np.minimum(n, m[with_prints]))
    out[with_prints] = 100 * common >= percent * (n + m[with_prints] - common)
    return out


def _likely(percent: int):
    threshold = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (
                batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b")
            )
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            j, used = estimate(x, y, n, m)
            ok = j >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            prints_a, prints_b = batch.column("prints_a"), batch.column("prints_b")
            for i in np.flatnonzero(ok).tolist():
                ok[i] = _room(prints_a[i], prints_b.slice(i, 1), int(n[i]), m[i : i + 1], percent)[0]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            xs, ys = batch.column("set_a"), batch.column("set_b")
            for i in range(batch.num_rows):
                x = np.frombuffer(xs[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(ys[i].as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


def _shared(ws: Workspace, classes: DataFrame) -> DataFrame:
    """k1, k2, cid, a of the band buckets that hold several classes; a is the smallest class of the bucket."""
    bands = classes.select("cid", F.posexplode("sig").alias("k1", "k2")).filter("k2 <> 0")
    leads = bands.groupBy("k1", "k2").agg(F.count("*").alias("size"), F.min("cid").alias("a")).filter("size > 1").drop("size")
    leads = ws.write(leads, "leads")
    shared = ws.write(bands.join(leads, ["k1", "k2"]).select("k1", "k2", "cid", "a"), "shared")
    ws.drop(leads)
    return shared


def _sketches(ws: Workspace, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, sig, prints of the classes that may be among wanted(cid), as a written table; registers of other classes are not shuffled."""
    return ws.write(may_match(classes.select("cid", "sig", "prints"), "cid", wanted), "sketches")


def size_class(n: Column, percent: int) -> Column:
    """Powers of a little more than 100 / percent: sets of a common share of `percent` lie in the same class or in neighbouring ones."""
    return F.floor(F.ln(n.cast("double")) / F.lit(max(1.001 * math.log(100 / percent), 1e-3))).cast("int")


def _near(ws: Workspace, shared: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Classes a (with their size n) and the components that they are likely to reach through a bucket that they share.

    A bucket is cut into ranges of two neighbouring size classes, the lower of which is the range's own; a pair is
    compared in the range that is the own one of its smaller set.
    In each range the classes outside its largest component are held against all classes
    of other components. Both sides are dealt into blocks of bounded size by a hash of the
    class, so that a bucket of any size is many small tasks. A task reports a component
    once for each class, however many of its members are likely.
    """
    sizes = classes.select("cid", "n").join(labels, F.col("cid") == F.col("node"), "left").select("cid", "n", F.coalesce("label", "cid").alias("label"))
    named = shared.join(sizes, "cid").withColumn("of", size_class(F.col("n"), percent)).withColumn("i", F.explode(F.array(F.col("of") - 1, F.col("of"))))
    named = ws.write(named.select("k1", "k2", "i", "cid", "label", "n", (F.col("i") == F.col("of")).alias("own"), (F.col("cid") == F.col("a")).alias("lead")), "named")
    keys = ["k1", "k2", "i"]
    parts = named.groupBy(*keys, "label").agg(F.count("*").alias("c"), F.bool_or("own").alias("own"), F.bool_or("lead").alias("lead"))
    # what shares a bucket with its smallest class has been verified with that
    open_ = (
        parts.groupBy(*keys)
        .agg(F.sum("c").alias("size"), F.count("*").alias("parts"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("main"), F.bool_or("own").alias("own"), F.bool_or("lead").alias("lead"))
        .filter("parts > 1 and own and (size > 2 or not lead)")
        .drop("own", "lead")
    )
    open_ = ws.write(open_, "open")
    slot = lambda n, size: F.pmod(F.xxhash64("cid", F.lit(size)), F.ceil(n / F.lit(float(size))).cast("long"))
    item = F.struct("cid", "label", "n", "sig", "prints", (F.col("label") != F.col("main")).alias("outer"), "own")
    chosen = ws.write(named.join(open_, keys), "chosen")
    ws.drop(named, open_)
    sketches = _sketches(ws, classes, chosen.select("cid").distinct())
    one = (F.col("size") <= BLOCK) & (F.col("size") - F.col("most") <= OUTER)
    full = chosen.join(sketches, "cid").select(*keys, item.alias("item"), one.alias("one"), slot(F.col("size"), BLOCK).alias("s"), slot(F.col("size") - F.col("most"), OUTER).alias("o"))
    full = ws.write(full, "members")
    ws.drop(chosen, sketches)
    # a range of one block is gathered once, with both sides in it
    near = full.filter("one").groupBy(*keys).agg(F.collect_list("item").alias("ys")).select("k1", "ys").mapInArrow(_likely_in_blocks(percent), "a long, n long, label long")
    y = full.filter("not one").groupBy(*keys, "s").agg(F.collect_list("item").alias("ys"))
    x = full.filter("not one and item.outer").groupBy(*keys, "o").agg(F.collect_list("item").alias("xs"))
    near = near.union(x.join(y, keys).select("k1", "xs", "ys").mapInArrow(_likely_in_blocks(percent), "a long, n long, label long")).distinct()
    near = ws.write(near, "near")
    ws.drop(full)
    return near


def _unpacked(items: pa.Array) -> tuple[np.ndarray, ...]:
    get = lambda name: items.field(name).to_numpy(zero_copy_only=False)
    sig = items.field("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS)
    return get("cid"), get("label"), get("n"), get("outer"), get("own"), sig, items.field("prints")


def _likely_in_blocks(percent: int):
    """k1, xs, ys -> a of xs, its size and label of ys where the estimate lets a pair pass, at the first band that it shares. Without xs these are the outer ones of ys."""
    threshold = percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                band, out_a, out_n, out_b = batch.column("k1")[i].as_py(), [], [], []
                items = batch.column("ys")[i].values
                yc, yl, yn, yo, yi, ys, yp = _unpacked(items)
                xc, xl, xn, _, xi, xs, xp = _unpacked(batch.column("xs")[i].values if "xs" in batch.schema.names else items.filter(items.field("outer")))
                y_used, y_bands = ys > 0, ys.view(np.int64)
                for k in range(len(xc)):
                    ok = (yl != xl[k]) & (yi | xi[k]) & (~yo | (yc > xc[k])) & (100 * np.minimum(yn, xn[k]) >= percent * np.maximum(yn, xn[k]))
                    at = np.flatnonzero(ok)
                    if not len(at):
                        continue
                    x_bands = xs[k].view(np.int64)
                    first = ((y_bands[at] == x_bands) & (x_bands != 0)).argmax(axis=1)
                    at = at[first == band]
                    if not len(at):
                        continue
                    used = (y_used[at] | (xs[k] > 0)).sum(axis=1)
                    same = ((ys[at] == xs[k]) & (xs[k] > 0)).sum(axis=1)
                    j = (same - expected_collisions(yn[at], np.full(len(at), xn[k]))) / np.maximum(used, 1)
                    at = at[j >= threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))]
                    if not len(at):
                        continue
                    at = at[_room(xp[k], yp.take(pa.array(at)), int(xn[k]), yn[at], percent)]
                    reached = np.unique(yl[at])
                    out_a.append(np.full(len(reached), xc[k]))
                    out_n.append(np.full(len(reached), xn[k]))
                    out_b.append(reached)
                if out_a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_a, out_n, out_b)], ["a", "n", "label"])

    return run


def _reached(percent: int):
    """xs, ys (cid, elements) -> for each x the first y whose full set reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                xs, ys, out = batch.column("xs")[i].values, batch.column("ys")[i].values, []
                body = [np.frombuffer(e.as_buffer(), dtype=np.uint64) for e in ys.field("elements")]
                cid, size = ys.field("cid").to_numpy(), np.asarray([len(e) for e in body])
                flat, at = np.concatenate(body), np.r_[0, np.cumsum(size)[:-1]]
                for a, e in zip(xs.field("cid").to_pylist(), xs.field("elements"), strict=True):
                    x = np.frombuffer(e.as_buffer(), dtype=np.uint64)
                    hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
                    common = np.add.reduceat(hit, at, dtype=np.int64)
                    ok = np.flatnonzero((100 * common >= percent * (size + len(x) - common)) & (cid != a))
                    if len(ok):
                        out.append((a, int(cid[ok[0]])))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _confirm_members(ws: Workspace, sets: DataFrame, members: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """Links between the classes a of near(a, n, label) and members(cid, n, label) of the component: one for each block that has any.

    Full sets are dealt into blocks of about `BLOCK_BYTES`, so that a component of any size
    is many tasks of bounded size.
    """

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        slots = F.ceil(F.sum(8 * F.col("n")) / F.lit(float(BLOCK_BYTES))).cast("long")
        totals = ws.write(rows.groupBy("label").agg(slots.alias("slots")), "totals")
        slot = F.pmod(F.xxhash64("cid", F.lit(name)), F.col("slots"))
        blocks = rows.join(totals, "label").select("cid", "label", slot.alias(f"slot_{name}")).join(sets, "cid").groupBy("label", f"slot_{name}")
        return blocks.agg(F.collect_list(F.struct("cid", "elements")).alias(name))

    ys = dealt(members.join(near.select("label").distinct(), "label", "left_semi"), "ys")
    xs = dealt(near.select(F.col("a").alias("cid"), "n", "label"), "xs")
    return ws.write(xs.join(ys, "label").select("xs", "ys").mapInArrow(_reached(percent), "a long, b long"), "links")


def _components(ws: Workspace, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, label of all classes that are linked with another one."""
    shared = _shared(ws, classes)
    links = _confirm(ws, docs, classes, _likely_pairs(ws, classes, shared.filter("cid <> a").select("a", F.col("cid").alias("b")).distinct(), percent), k, percent)
    first = components(ws, links)
    near = _near(ws, shared, first, classes, percent)
    ws.drop(shared)
    if not near.limit(1).count():
        return first
    members = classes.join(first, classes.cid == first.node, "left").select("cid", "n", F.coalesce("label", "cid").alias("label"))
    members = ws.write(members.join(near.select("label").distinct(), "label", "left_semi"), "reached")
    sets = _sets_of(ws, docs, classes, members.select("cid").union(near.select(F.col("a").alias("cid"))).distinct(), k)
    # first against the largest component that a class may reach: that joins most of what belongs together
    sizes = members.groupBy("label").agg(F.count("*").alias("size"))
    largest = near.join(sizes, "label").groupBy("a", "n").agg(F.max_by("label", F.struct("size", "label")).alias("label"))
    largest = ws.write(largest, "largest")
    links = ws.write(links.union(_confirm_members(ws, sets, members, largest, percent)), "links")
    second = components(ws, links)
    side = lambda name: second.select(F.col("node").alias(name), F.col("label").alias(f"of_{name}"))
    rest = near.join(largest.select("a", "label"), ["a", "label"], "left_anti").join(side("a"), "a", "left").join(side("label"), "label", "left")
    rest = ws.write(rest.filter(F.coalesce("of_a", "a") != F.coalesce("of_label", "label")).select("a", "n", "label"), "rest")
    labels = second
    if rest.limit(1).count():
        more = _confirm_members(ws, sets, members, rest, percent)
        if more.limit(1).count():
            labels = components(ws, links.union(more))
    ws.drop(near, members, sets, largest)
    return labels


def _sketched(ws: Workspace, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n_shingles, d1, d2 of each document; and d1, d2, n_shingles, component, head of each distinct set.

    head: the set whose rows stand for the component.
    """
    rows = ws.write(docs.mapInArrow(_sketch(k), "doc_id long, n_shingles long, d1 long, d2 long, sig array<long>, prints binary"), "sketch")
    classes = ws.write(
        rows.filter("n_shingles > 0")
        .groupBy("d1", "d2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("least"), F.any_value("sig").alias("sig"), F.any_value("prints").alias("prints"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    labels = _components(ws, docs, classes, k, percent).select("node", "label")
    named = classes.select("cid", "d1", "d2", "n", "least").join(labels, F.col("cid") == F.col("node"), "left")
    order = F.struct(F.col("least").isNull().alias("none"), "least", "n", "d1", "d2")
    heads = ws.write(named.filter("label is not null").groupBy("label").agg(F.min(order).alias("h")), "heads")
    first = F.col("h").isNull() | ((F.col("h.d1") == F.col("d1")) & (F.col("h.d2") == F.col("d2")) & (F.col("h.n") == F.col("n")))
    component = F.when(F.col("h").isNull(), F.col("least")).otherwise(F.col("h.least"))
    wide = named.join(heads, "label", "left").select("d1", "d2", F.col("n").alias("n_shingles"), component.alias("component"), first.alias("head"))
    wide = ws.write(wide, "wide")
    ws.drop(classes, heads)
    return rows.select("doc_id", "n_shingles", "d1", "d2"), wide


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept: one row per document."""
    ws = Workspace(docs.sparkSession, "near")
    rows, classes = _sketched(ws, docs.select("doc_id", "text"), k, percent)
    out = rows.join(classes, ["d1", "d2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def _likely_pairs(ws: Workspace, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose sizes and registers allow the threshold, as a written table."""
    size = lambda s: classes.select(F.col("cid").alias(s), F.col("n").alias(f"n_{s}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    sized = ws.write(sized, "sized")
    sketches = _sketches(ws, classes, sized.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    side = lambda s: sketches.select(F.col("cid").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("prints").alias(f"prints_{s}"))
    likely = ws.write(sized.join(side("a"), "a").join(side("b"), "b").mapInArrow(_likely(percent), "a long, b long"), "likely")
    ws.drop(sized, sketches)
    return likely


def _sets_of(ws: Workspace, docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """cid, elements: the full shingle sets of wanted(cid), taken from the texts again."""
    heads = ws.write(classes.join(wanted, "cid").select("cid", "d1", "d2", "n", "least"), "wanted")
    texts = may_match(docs.select("doc_id", "text"), "doc_id", heads.select("least")).select("text")
    sets = (
        texts.mapInArrow(_sets(k), "n long, d1 long, d2 long, elements binary")
        .join(heads.select("cid", "d1", "d2", "n"), ["d1", "d2", "n"])
        .groupBy("cid")
        .agg(F.any_value("elements").alias("elements"))
    )
    return ws.write(sets, "sets")


def _confirm(ws: Workspace, docs: DataFrame, classes: DataFrame, likely: DataFrame, k: int, percent: int) -> DataFrame:
    """Of candidate pairs those whose full sets reach the threshold, as a written table; likely is one too."""
    sets = _sets_of(ws, docs, classes, likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), k)
    a = sets.select(F.col("cid").alias("a"), F.col("elements").alias("set_a"))
    b = sets.select(F.col("cid").alias("b"), F.col("elements").alias("set_b"))
    links = ws.write(likely.join(a, "a").join(b, "b").mapInArrow(_verified(percent), "a long, b long"), "links")
    ws.drop(likely, sets)
    return links


def _digests(k: int, place: int):
    """Rows with a text at `place` -> the same rows with n, d1, d2 of their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, d = [], []
            for s in shingle_sets(*K.buffers(batch.column(place)), k):
                n.append(len(s))
                d.append(K.set_digest(s))
            extra = [pa.array(x, pa.int64()) for x in (n, [a for a, _ in d], [b for _, b in d])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [str(i) for i in range(batch.num_columns + 3)])

    return run


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of docs, and all rows with an empty set; columns stay as they are.

    A row goes by its id and its set, so rows that share an id are judged one by one. Only
    rows whose id may have one that goes are shuffled with their text.
    """
    ws, names = Workspace(docs.sparkSession, "near"), docs.columns
    rows, classes = _sketched(ws, docs.select("doc_id", "text"), k, percent)
    judged = rows.filter("n_shingles > 0").join(classes, ["d1", "d2", "n_shingles"])
    stays = F.col("doc_id").eqNullSafe(F.col("component")) & F.col("head")
    judged = judged.groupBy("doc_id", "n_shingles", "d1", "d2").agg(F.every(stays).alias("stays"), F.count("*").alias("copies"))
    judged = ws.write(judged.filter("not stays or copies > 1").drop("copies"), "judged")
    may, others = by_bit_set(docs, "doc_id", bit_set(judged.select(slot_of("doc_id").alias("slot"))))
    n, d1, d2, gone = (fresh(c, docs) for c in ("__n", "__d1", "__d2", "__stays"))
    schema = T.StructType([*docs.schema.fields])
    for c in (n, d1, d2):
        schema = schema.add(c, "long")
    may = may.mapInArrow(_digests(k, names.index("text")), schema)
    told = judged.select(F.col("doc_id").alias(f"{gone}_id"), F.col("n_shingles").alias(f"{gone}_n"), F.col("d1").alias(f"{gone}_1"), F.col("d2").alias(f"{gone}_2"), F.col("stays").alias(gone))
    same = may.doc_id.eqNullSafe(told[f"{gone}_id"]) & (F.col(n) == F.col(f"{gone}_n")) & (F.col(d1) == F.col(f"{gone}_1")) & (F.col(d2) == F.col(f"{gone}_2"))
    kept = may.join(told, same, "left_anti").select(*names)
    if judged.filter("stays").limit(1).count():
        once = may.join(told.filter(gone), same, "left_semi").dropDuplicates(["doc_id", n, d1, d2])
        kept = kept.union(once.select(*names))
    return others.union(kept)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4)


QUERIES = {"op8_minhash_near_dedup": op8_minhash_near_dedup}

#: All pairs of distinct sets that share a shingle, then the components' least ids by label passing.
ORACLE = {
    "op8_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 3, len(ws))], ' ') AS sh
  FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, p.c AS c, na.n AS na, nb.n AS nb FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
arcs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM arcs UNION SELECT r.node, arcs.b FROM reach r JOIN arcs ON r.seen = arcs.a),
c AS (SELECT node, min(seen) AS comp FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.comp, w.doc_id) AS component_id,
       coalesce(c.comp, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
}
