"""Patch data sets: windows around centres with their metadata planes, augmented, labelled and stored by patch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import acoustic as A
from ..operators import seabed as B
from ..operators import slices
from ..operators.blocks import BlockTable
from ..operators.labels import DISC
from ..sources.tables import new_rows, stored_table

#: Metadata planes in their order; a True of the same name in `meta` adds them (portion_day adds two).
META = ("portion_year", "portion_day", "time_diff", "depth_rel", "depth_abs_surface", "depth_abs_seabed")


@dataclass(frozen=True)
class Recipe:
    """What happens to a patch. Frequencies stand in the order of the channels; borders are refined on the last one."""

    freqs: tuple[int, ...]
    height: int
    width: int
    #: "train": refined borders, classes. "evaluate": classes with OTHER, refined borders, seabed and overlap codes, border value 0.
    chain: str = "train"
    meta: tuple[str, ...] = ()
    #: Decibels mapped to 0 .. 1 instead of -75 .. 0.
    scaled: bool = False
    #: Noise and flips drawn from this seed and the patch's key; None leaves patches as they are.
    seed: int | None = None
    overlap: int = 0
    low: float = 1e-7
    high: float = 1e-4
    #: Days of half a ping's distance that count as 1 in time_diff.
    unit: float = 6e-6

    def channels(self) -> list[str]:
        out = [f"f{f}" for f in self.freqs]
        for name in META:
            if name in self.meta:
                out += ["sin_day", "cos_day"] if name == "portion_day" else [name]
        return out


def keyed_uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """The numbers of functions.acoustic.keyed_uniform."""
    m = (1 << 31) - 1  # bits kept: the remainder by 2**31, of negative numbers too
    x = ((key & m) * 1103515245 + seed * 12345 + 12345) & m
    x = (((x * x) >> 16) + x) & m
    x = (x * 1103515245 + 12345 + seed * 7919) & m
    return ((((x * x) >> 16) + x) & m) / 2147483648.0


def noisy(data: np.ndarray, key: int, seed: int, share: float = 0.05) -> np.ndarray:
    """Half of the patches: `share` of the cells times U(1, 10) or U(0, 1), half each. Every cell of every channel has a key of its own."""
    if keyed_uniform(np.array([key]), seed)[0] >= 0.5:
        return data
    cells = key * data.size + np.arange(data.size, dtype=np.int64).reshape(data.shape)
    u, v = keyed_uniform(cells, seed + 1), keyed_uniform(cells, seed + 2)
    return np.where(u < share / 2, data * (1 + 9 * v), np.where(u < share, data * v, data))


def _moved(mask: np.ndarray) -> list[np.ndarray]:
    """mask moved by each offset of the disc, with unset cells coming in; the disc reaches three cells."""
    h, w = mask.shape
    wide = np.zeros((h + 6, w + 6), dtype=bool)
    wide[3 : 3 + h, 3 : 3 + w] = mask
    return [wide[3 - dy : 3 - dy + h, 3 - dx : 3 - dx + w] for dy, dx in DISC]


def closed(mask: np.ndarray) -> np.ndarray:
    """Binary closing with the disc; cells beyond the edges count as unset in both steps."""
    if not mask.any():
        return mask
    return np.logical_and.reduce(_moved(np.logical_or.reduce(_moved(mask))))


def refined(labels: np.ndarray, v: np.ndarray, low: float, high: float) -> np.ndarray:
    """Labels above 0 outside the closed seed (low < v < high) become BORDER, within the smallest box around the data."""
    known = np.argwhere(labels != A.IGNORE)
    if not len(known):
        return labels
    (y0, x0), (y1, x1) = known.min(axis=0), known.max(axis=0) + 1
    box = labels[y0:y1, x0:x1]
    inside = closed((box > 0) & (v[y0:y1, x0:x1] > low) & (v[y0:y1, x0:x1] < high))
    out = labels.copy()
    out[y0:y1, x0:x1] = np.where((box > 0) & ~inside, A.BORDER, box)
    return out


def classes(labels: np.ndarray, other: bool) -> np.ndarray:
    """0 background, 1 sandeel, 2 other, IGNORE for anything else, or OTHER for further species."""
    rest = np.where((labels > 0) & other, A.OTHER, A.IGNORE)
    return np.select([labels == 0, labels == 27, labels == 1], [0, 1, 2], rest)


def _planes(r: Recipe, cy: int, ping: np.ndarray) -> list[np.ndarray]:
    """Metadata planes; ping has time_diff, seabed, sin and cos of the centre's time of day, and the portion of the year, for each column."""
    rows = (cy - r.height // 2 + np.arange(r.height))[:, None]
    time_diff, bottom, sin_day, cos_day, year = (ping[:, k][None, :] for k in range(5))
    full = lambda x: np.broadcast_to(x, (r.height, r.width))
    made = {
        "portion_year": lambda: [full(year)],
        "portion_day": lambda: [full(sin_day), full(cos_day)],
        "time_diff": lambda: [full(time_diff)],
        "depth_rel": lambda: [np.divide(rows, bottom, out=np.full((r.height, r.width), np.nan), where=np.broadcast_to(bottom != 0, (r.height, r.width)))],
        "depth_abs_surface": lambda: [full(rows / r.height)],
        "depth_abs_seabed": lambda: [(bottom - rows) / r.height],
    }
    return [plane for name in META if name in r.meta for plane in made[name]()]


def made(r: Recipe, key: int, cy: int, data: np.ndarray, labels: np.ndarray, bottom: np.ndarray, ping: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """One patch: channels and labels after augmentation, label chain and data chain, in this order."""
    data = np.where(np.isfinite(data), data, 0.0)
    meta = np.stack(_planes(r, cy, ping)) if r.meta else np.zeros((0, r.height, r.width))
    if r.seed is not None:
        data = noisy(data, key, r.seed)
        if keyed_uniform(np.array([key]), r.seed + 4)[0] < 0.5:
            data, meta, labels, bottom = data[:, :, ::-1], meta[:, :, ::-1], labels[:, ::-1], bottom[::-1]
    if r.chain == "train":
        labels = classes(refined(labels, data[-1], r.low, r.high), False)
    else:
        labels = refined(classes(labels, True), data[-1], r.low, r.high)
        rows = (cy - r.height // 2 + 1 + np.arange(r.height))[:, None]
        labels = np.where((labels == 0) & (rows >= bottom[None, :] + 10), A.SEABED, labels)
        if r.overlap:
            edge = np.ones(labels.shape, dtype=bool)
            edge[r.overlap : r.height - r.overlap, r.overlap : r.width - r.overlap] = False
            labels = np.where(edge & (labels != A.IGNORE), A.OVERLAP, labels)
    data = np.clip(10 * np.log10(data + A.EPS), A.FLOOR_DB, 0.0)
    if r.scaled:
        data = 1 + data / -A.FLOOR_DB
    if r.chain != "train":
        data = np.where(labels[None] == A.IGNORE, 0.0, data)
    return np.concatenate([data, meta]), labels


#: Pings of a block, and the largest number of patches that are made from one copy of a block.
BLOCK, MOST = 256, 128


def _blocks(r: Recipe, kind: pa.DataType, limits: tuple[str, ...] = ()) -> Callable[[pa.Table], pa.Table]:
    """Makes the patches of one block: rows of part -1 are patches, the others are the pings' values of a frequency, labels or metadata."""
    depth = len(r.freqs)
    schema = pa.schema([("raw_file", pa.string()), ("patch_id", kind), ("cy", pa.int32()), ("cx", pa.int32()), ("data", pa.list_(pa.list_(pa.float32()))), ("labels", pa.list_(pa.int16()))] + [(c, pa.int32()) for c in limits])

    def run(table: pa.Table) -> pa.Table:
        if pc.all(pc.greater_equal(table.column("part"), 0)).as_py():
            # no patch fell to this copy of a crowded block
            return schema.empty_table()
        part, ping = table.column("part").to_numpy(), table.column("ping_idx").to_numpy()
        values = table.column("values").combine_chunks()
        flat, at = values.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        own = np.flatnonzero(part < 0)
        held = part >= 0
        lo, hi = (int(ping[held].min()), int(ping[held].max()) + 1) if held.any() else (0, 1)

        def matrix(k: int, n: int, fill: float, skip: int = 0) -> np.ndarray:
            """Values of part k by ping, `skip` leading ones left out, filled up to n."""
            out, rows, cols = np.full((hi - lo, n), fill), np.flatnonzero(part == k), np.arange(n)
            there, own = cols < (lengths[rows] - skip)[:, None], np.full((len(rows), n), fill)
            own[there] = flat[((at[rows] + skip)[:, None] + cols)[there]]
            out[ping[rows] - lo] = own
            return out

        lengths = np.diff(at)
        longest = lambda ks, skip: max(0, int(lengths[np.isin(part, list(ks))].max(initial=0)) - skip)
        cube = [matrix(k, longest(range(depth), 0), 0.0) for k in range(depth)]
        marks = matrix(depth, longest([depth], 1), A.IGNORE, 1)
        bottom = np.full(hi - lo, np.inf)
        for i in np.flatnonzero(part == depth):
            bottom[ping[i] - lo] = flat[at[i]]
        meta = matrix(depth + 1, 5, np.nan) if r.meta else None

        def cut(m: np.ndarray, pings: np.ndarray, inside: np.ndarray, rows: np.ndarray, fill: float) -> np.ndarray:
            """The cells (rows, pings) of a matrix by ping; `fill` for pings that are not inside."""
            out = np.full((len(rows), len(pings)), fill)
            x, y = np.flatnonzero(inside), np.flatnonzero((rows >= 0) & (rows < m.shape[1]))
            if len(x) and len(y):
                out[np.ix_(y, x)] = m[np.ix_(pings[x] - lo, rows[y])].T
            return out

        patches = [table.column(c).take(pa.array(own)).to_pylist() for c in ("raw_file", "patch_id", "key", "cy", "cx", "last", "lo", "hi")]
        all_data, all_labels = [], []
        for _, _, key, cy, cx, last, least, end in zip(*patches, strict=True):
            pings, rows = cx - r.width // 2 + 1 + np.arange(r.width), cy - r.height // 2 + 1 + np.arange(r.height)
            inside = (pings >= max(lo, least)) & (pings < min(hi, end))
            data = np.stack([cut(m, pings, inside, rows, 0.0) for m in cube])
            under = np.where(inside, bottom[np.clip(pings - lo, 0, hi - lo - 1)], np.inf)
            planes = None
            if r.meta:
                # of a ping each column has time_diff and seabed; the time of day is that of the centre
                planes = meta[np.clip(pings - 1, 0, last) - lo].copy()
                planes[:, 2:4] = meta[min(max(cx, 0), last) - lo, 2:4]
            out, labels = made(r, key, cy, data, cut(marks, pings, inside, rows, A.IGNORE).astype(np.int64), under, planes)
            all_data.append(out.astype(np.float32))
            all_labels.append(labels.astype(np.int16).ravel())
        flat_data = np.stack(all_data)
        count, depth_out = flat_data.shape[:2]
        cells = r.height * r.width
        channels = pa.ListArray.from_arrays(pa.array(np.arange(count * depth_out + 1, dtype=np.int32) * cells), pa.array(flat_data.ravel()))
        return pa.table(
            {
                "raw_file": pa.array(patches[0], pa.string()),
                "patch_id": pa.array(patches[1], kind),
                "cy": pa.array(patches[3], pa.int32()),
                "cx": pa.array(patches[4], pa.int32()),
                "data": pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * depth_out), channels),
                "labels": pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * cells), pa.array(np.concatenate(all_labels))),
                **{c: pa.array(patches[6 + k], pa.int32()) for k, c in enumerate(limits)},
            }
        )

    return run


def patch_set(patches: DataFrame, recipe: Recipe, sv: DataFrame | BlockTable, labels: DataFrame, bottom: DataFrame, pings: DataFrame) -> DataFrame:
    """patches(raw_file, patch_id, key, cy, cx) -> raw_file, patch_id, cy, cx, data, labels: one row for each patch.

    data has an array for each of recipe.channels(), labels one of classes and codes; cells go row by row.
    sv, labels and bottom are profiles, label maps and seabed indices by ping, pings their times.
    Metadata are read at the patch's centre, or at columns half a window ahead of it and on; pings beyond
    a file's ends take the file's first or last value. Pings are dealt in blocks of BLOCK with a halo of half
    a window, so what is shuffled grows with the pings, not with the cells of the patches. A block with more than
    MOST patches is dealt several times, so a task holds one block and at most about MOST patches. Profiles that are
    stored in blocks stay in their buckets, and what else a block needs is brought to them.
    Patches with `lo` and `hi` see the pings from lo to hi - 1 only and keep both columns; they have no metadata.
    """
    r, half = recipe, recipe.width // 2 + 1
    if isinstance(sv, BlockTable) and sv.halo < half:
        sv = sv.table()
    stored = isinstance(sv, BlockTable)
    size = sv.size if stored else BLOCK
    if r.chain not in ("train", "evaluate") or not set(r.meta) <= set(META):
        raise ValueError("unknown chain or metadata")
    limits = ("lo", "hi") if "lo" in patches.columns else ()
    if limits and r.meta:
        raise ValueError("patches with limits have no metadata")
    keys = ["raw_file", "__b"]
    files = pings.groupBy("raw_file").agg(F.max("ping_idx").alias("last"))
    block = F.floor(F.greatest(F.lit(0), F.least(F.col("cx"), F.col("last"))) / F.lit(size)).cast("int").alias("__b")
    centres = patches.select("raw_file", "patch_id", F.col("key").cast("long").alias("key"), F.col("cy").cast("int").alias("cy"), F.col("cx").cast("int").alias("cx"), *(F.col(c).cast("int").alias(c) if limits else F.lit(v).alias(c) for c, v in (("lo", 0), ("hi", (1 << 31) - 1)))).join(files, "raw_file", "left")
    # a file without any ping has patches of fill values alone
    centres = centres.withColumn("last", F.coalesce("last", F.lit(0))).withColumn("__b", block)
    slots = F.ceil(F.col("__n") / F.lit(MOST)).cast("int")
    crowds = centres.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, slots.alias("__n"))
    centres = centres.join(crowds, keys).withColumn("__s", F.pmod(F.xxhash64("patch_id"), F.col("__n")).cast("int"))
    reach = F.sequence(F.greatest(F.floor((F.col("ping_idx") - half) / F.lit(size)), F.lit(0)).cast("int"), F.floor((F.col("ping_idx") + half) / F.lit(size)).cast("int"))
    place = F.element_at(F.create_map(*[F.lit(v) for k, f in enumerate(r.freqs) for v in (f, k)]), F.col("freq_hz"))
    # files without patches are left out where they are read; their names are few
    asked_files = F.broadcast(centres.select("raw_file").distinct())
    labels, bottom, pings = (t.join(asked_files, "raw_file", "left_semi") for t in (labels, bottom, pings))
    profiles = sv.rows.withColumn("__b", F.col("block")) if stored else sv.join(asked_files, "raw_file", "left_semi")
    profiles = profiles.filter(F.col("freq_hz").isin(list(r.freqs))).withColumns({"part": place, "values": F.col("sv").cast("array<double>")})
    marks = labels.select("raw_file", "ping_idx", "labels").join(bottom.select("raw_file", "ping_idx", "seabed_idx"), ["raw_file", "ping_idx"], "left")
    under = F.array(F.coalesce(F.col("seabed_idx").cast("double"), F.lit(float("inf"))))
    rows = marks.select("raw_file", "ping_idx", F.lit(len(r.freqs)).alias("part"), F.concat(under, F.col("labels").cast("array<double>")).alias("values"))
    if r.meta:
        rows = rows.unionByName(_meta(r, bottom, pings).withColumn("part", F.lit(len(r.freqs) + 1)))
    if not stored:
        rows = rows.unionByName(profiles.select("raw_file", "ping_idx", "part", "values"))
    slot = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    dealt = rows.withColumn("__b", F.explode(reach)).join(crowds, keys).withColumn("__s", slot)
    kind = patches.schema["patch_id"].dataType
    none = lambda t: F.lit(None).cast(t)
    without_patch = lambda df: df.select(*keys, "__s", "part", "ping_idx", "values", none(kind).alias("patch_id"), none("long").alias("key"), none("int").alias("cy"), *(none("int").alias(c) for c in ("cx", "last", "lo", "hi")))
    asked = centres.select(*keys, "__s", F.lit(-1).alias("part"), F.lit(0).alias("ping_idx"), none("array<double>").alias("values"), "patch_id", "key", "cy", "cx", "last", "lo", "hi")
    schema = T.StructType([T.StructField("raw_file", T.StringType()), T.StructField("patch_id", kind)])
    schema = schema.add("cy", T.IntegerType()).add("cx", T.IntegerType()).add("data", T.ArrayType(T.ArrayType(T.FloatType()))).add("labels", T.ArrayType(T.ShortType()))
    for c in limits:
        schema = schema.add(c, T.IntegerType())
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.int64() if isinstance(kind, T.LongType) else pa.int32()
    dealt = asked.unionByName(without_patch(dealt))
    if stored:
        # dealt like the buckets, so the union keeps them; the pings of a block and half a window around it
        near = profiles.filter((F.col("ping_idx") >= F.col("__b") * size - half) & (F.col("ping_idx") < (F.col("__b") + 1) * size + half))
        dealt = dealt.repartition(sv.buckets, *keys).unionByName(without_patch(near.join(crowds.hint("shuffle_hash"), keys).withColumn("__s", slot)))
    return dealt.groupBy(*keys, "__s").applyInArrow(_blocks(r, arrow, limits), schema)


def patch_labels(patches: DataFrame, recipe: Recipe, sv: DataFrame | BlockTable, labels: DataFrame, bottom: DataFrame, pings: DataFrame) -> DataFrame:
    """patch_set -> raw_file, patch_id, ping_idx, r, label: the cells of all patches with the classes and codes of the label chain."""
    r = recipe
    made = patch_set(patches, r, sv, labels, bottom, pings).select("raw_file", "patch_id", "cy", "cx", F.posexplode("labels").alias("i", "label"))
    x, y = F.col("i") % r.width, F.floor(F.col("i") / r.width)
    place = lambda p, c, size: slices.patch_to_data(p, F.col(c), size).cast("int")
    return made.select("raw_file", "patch_id", place(x, "cx", r.width).alias("ping_idx"), place(y, "cy", r.height).alias("r"), F.col("label").cast("int").alias("label"))


def _columns(r: Recipe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cells = batch.column("labels").flatten().to_numpy(zero_copy_only=False).reshape(n, r.height, r.width).swapaxes(1, 2)
            cx, cy = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy"))
            ping = (cx - r.width // 2 + 1)[:, None] + np.arange(r.width, dtype=np.int32)
            at = pa.array(np.arange(n * r.width + 1, dtype=np.int32) * r.height)
            files = batch.column("raw_file").take(pa.array(np.repeat(np.arange(n), r.width)))
            cols = [files, pa.array(ping.ravel()), pa.array(np.repeat(cy - r.height // 2 + 1, r.width)), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(cells).ravel()))]
            yield pa.RecordBatch.from_arrays(cols, ["raw_file", "ping_idx", "top", "labels"])

    return run


def patch_columns(patches: DataFrame, recipe: Recipe, sv: DataFrame | BlockTable, labels: DataFrame, bottom: DataFrame, pings: DataFrame) -> DataFrame:
    """patch_set -> raw_file, ping_idx, top, labels: the columns of all patches, with their classes and codes from range bin `top` on."""
    made = patch_set(patches, recipe, sv, labels, bottom, pings).select("raw_file", "cy", "cx", "labels")
    return made.mapInArrow(_columns(recipe), "raw_file string, ping_idx int, top int, labels array<short>")


def _meta(r: Recipe, bottom: DataFrame, pings: DataFrame) -> DataFrame:
    """time_diff, seabed_idx, sine and cosine of the time of day, and the portion of the year of the file's start, for every ping."""
    by_ping = B.time_difference(pings.select("raw_file", "ping_idx", "ping_time"), r.unit).join(bottom.select("raw_file", "ping_idx", "seabed_idx"), ["raw_file", "ping_idx"], "left")
    times = pings.select("raw_file", "ping_idx", "ping_time").join(pings.groupBy("raw_file").agg(F.min("ping_time").alias("__start")), "raw_file")
    turn = 2 * F.pi() * A.portion_of_day(A.datenum(F.col("ping_time")))
    times = times.select("raw_file", "ping_idx", F.sin(turn).alias("__s"), F.cos(turn).alias("__c"), A.portion_of_year(F.col("__start")).alias("__y"))
    values = F.array(*[F.col(c).cast("double") for c in ("time_diff", "seabed_idx", "__s", "__c", "__y")])
    return by_ping.join(times, ["raw_file", "ping_idx"]).select("raw_file", "ping_idx", values.alias("values"))


def store_patches(patches: DataFrame, path: str, make: Callable[[DataFrame], DataFrame]) -> None:
    """Adds make(patches) to the table at path for those patches that it does not have; stored ones are not made again."""
    left = new_rows(patches, stored_table(patches.sparkSession, path), ["raw_file", "patch_id"])
    make(left).write.mode("append").parquet(path)
