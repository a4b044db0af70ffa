"""Label transforms on cells and patches, and binary morphology on sparse cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.acoustic import BORDER, IGNORE, OVERLAP, SEABED, species_class, species_class_other

#: The cells of a disc in a 7 x 7 square: 37 offsets.
DISC = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 10]


def _spread(cells: DataFrame, keys: list[str]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in DISC])
    out = cells.select(*keys, "ping_idx", "r", F.explode(steps).alias("d"))
    return out.select(*keys, (F.col("ping_idx") + F.col("d.dx")).alias("ping_idx"), (F.col("r") + F.col("d.dy")).alias("r"))


def closed_cells(cells: DataFrame, box: DataFrame, keys: list[str]) -> DataFrame:
    """Binary closing of cells(keys, ping_idx, r) with DISC inside box(keys, x0, x1, y0, y1); outside counts as 0."""
    inside = (F.col("ping_idx").between(F.col("x0"), F.col("x1"))) & (F.col("r").between(F.col("y0"), F.col("y1")))
    grown = _spread(cells, keys).join(box, keys).filter(inside).select(*keys, "ping_idx", "r").distinct()
    kept = _spread(grown, keys).groupBy(*keys, "ping_idx", "r").count().filter(F.col("count") == len(DISC)).drop("count")
    return kept


def refined_borders(cells: DataFrame, box: DataFrame, keys: list[str], low: float = 1e-7, high: float = 1e-4, outside: int = BORDER) -> DataFrame:
    """cells(keys, ping_idx, r, label, v): labels > 0 outside the closed seed become `outside`.

    The seed is label > 0 and low < v < high; only seed cells are spread and only positive labels are
    joined, so the shuffled work grows with the schools.
    """
    seed = cells.filter((F.col("label") > 0) & (F.col("v") > low) & (F.col("v") < high)).select(*keys, "ping_idx", "r")
    inside = closed_cells(seed, box, keys).withColumn("__in", F.lit(True))
    positive = F.coalesce(F.col("label") > 0, F.lit(False))
    joined = cells.filter(positive).join(inside, [*keys, "ping_idx", "r"], "left")
    marked = joined.withColumn("label", F.when(F.col("__in").isNull(), outside).otherwise(F.col("label")))
    return marked.select(*cells.columns).union(cells.filter(~positive))


def refined_patches(cells: DataFrame, keys: list[str], low: float = 1e-7, high: float = 1e-4, outside: int = BORDER) -> DataFrame:
    """refined_borders inside the smallest box around the cells of a patch that are not IGNORE; a patch without any stays as it is."""
    known = cells.filter(F.col("label") != IGNORE).groupBy(*keys)
    box = known.agg(F.min("ping_idx").alias("x0"), F.max("ping_idx").alias("x1"), F.min("r").alias("y0"), F.max("r").alias("y1"))
    return refined_borders(cells, box, keys, low, high, outside)


def training_chain(cells: DataFrame, keys: list[str], low: float = 1e-7, high: float = 1e-4) -> DataFrame:
    """Label chain of training patches: refined borders of all species, then classes."""
    return refined_patches(cells, keys, low, high).withColumn("label", species_class(F.col("label")))


def evaluation_chain(cells: DataFrame, keys: list[str], height: int, width: int, overlap: int, low: float = 1e-7, high: float = 1e-4) -> DataFrame:
    """Label chain of evaluated patches: classes with OTHER, refined borders, seabed code, overlap code.

    cells: keys, x, y (place in the patch), ping_idx, r, label (IGNORE outside the data), v and the ping's seabed_idx.
    """
    out = refined_patches(cells.withColumn("label", species_class_other(F.col("label"))), keys, low, high)
    out = out.withColumn("label", seabed_code(F.col("label"), F.col("r"), F.col("seabed_idx")))
    return out.withColumn("label", overlap_masked(F.col("label"), F.col("y"), F.col("x"), height, width, overlap))


def seabed_code(label: Column, r: Column, seabed: Column, pad: int = 10) -> Column:
    """SEABED for a background label at or below seabed + pad."""
    return F.when((label == 0) & (r >= seabed + pad), SEABED).otherwise(label)


def seabed_masked(labels: Column | str, seabed: Column, top: Column | int = 0, pad: int = 10) -> Column:
    """Background labels at and below seabed + pad become SEABED; top is the range index of the first label."""
    return F.transform(labels, lambda y, r: seabed_code(y, r + top, seabed, pad))


def overlap_masked(label: Column, y: Column, x: Column, height: int, width: int, overlap: int) -> Column:
    """Outer cells of a patch become OVERLAP, except IGNORE ones."""
    if overlap == 0:
        return label
    edge = (y < overlap) | (y >= height - overlap) | (x < overlap) | (x >= width - overlap)
    return F.when(edge & (label != IGNORE), OVERLAP).otherwise(label)


def object_spans(objects: DataFrame, grow: int) -> DataFrame:
    """raw_file, ping_idx, spans: what the boxes of objects, grown by `grow` (upper edges exclusive), cover of each ping, as disjoint ascending [lo, hi).

    Boxes that stand on a ping twice or overlap are merged by a sweep over their lower edges, so a ping
    never gathers more spans than its profile has room for.
    """
    each = objects.select("raw_file", F.explode(F.sequence(F.col("x0") - grow, F.col("x1") + grow - 1)).alias("ping_idx"), (F.col("y0") - grow).alias("lo"), (F.col("y1") + grow).alias("hi"))
    each = each.filter("lo < hi").groupBy("raw_file", "ping_idx", "lo").agg(F.max("hi").alias("hi"))
    ping = Window.partitionBy("raw_file", "ping_idx").orderBy("lo")
    reach = F.max("hi").over(ping.rowsBetween(Window.unboundedPreceding, -1))
    opened = each.withColumn("__new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    merged = opened.withColumn("__span", F.sum("__new").over(ping)).groupBy("raw_file", "ping_idx", "__span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("raw_file", "ping_idx").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def object_pings(objects: DataFrame, grow: int) -> DataFrame:
    """raw_file, ping_idx: the pings of the boxes of objects, grown by `grow` (upper edges exclusive)."""
    return objects.select("raw_file", F.explode(F.sequence(F.col("x0") - grow, F.col("x1") + grow - 1)).alias("ping_idx")).distinct()


def _near(objects: DataFrame, grow: int, trace: bool) -> DataFrame:
    """raw_file, ping_idx, __near: with trace true for pings of grown boxes, else their spans."""
    if not trace:
        return object_spans(objects, grow).withColumnRenamed("spans", "__near")
    return object_pings(objects, grow).withColumn("__near", F.lit(True))


def region_masked(cells: DataFrame, objects: DataFrame, grow: int = 20, trace: bool = False, outside: int = -1, compat: bool = False) -> DataFrame:
    """cells(raw_file, ping_idx, r, label) keep labels inside object boxes grown by `grow` (upper edge exclusive); with trace, at all ranges of their pings.

    Other cells become IGNORE; with compat they become `outside`, which no evaluation ignores, so
    they count as negatives there. Boxes are exploded to pings, so the join is an equi-join; they are never
    broadcast, as what an explosion makes of a small table is not small. Pings with
    a label map (raw_file, ping_idx, labels) meet the boxes as such and become cells after that.
    """
    code = outside if compat else IGNORE
    if "labels" in cells.columns:
        near = cells.select("raw_file", "ping_idx", "labels").join(_near(objects, grow, trace).hint("merge"), ["raw_file", "ping_idx"], "left")
        each = near.select("raw_file", "ping_idx", "__near", F.posexplode("labels").alias("r", "label"))
        hit = F.col("__near") if trace else F.exists("__near", lambda s: (F.col("r") >= s["lo"]) & (F.col("r") < s["hi"]))
        return each.select("raw_file", "ping_idx", "r", F.when(hit, F.col("label")).otherwise(code).alias("label"))
    if trace:
        joined = cells.join(object_pings(objects, grow).withColumn("__in", F.lit(True)).hint("merge"), ["raw_file", "ping_idx"], "left")
        return joined.withColumn("label", F.when(F.col("__in").isNotNull(), F.col("label")).otherwise(code)).select(*cells.columns)
    joined = cells.join(object_spans(objects, grow).hint("merge"), ["raw_file", "ping_idx"], "left")
    hit = F.exists("spans", lambda s: (F.col("r") >= s["lo"]) & (F.col("r") < s["hi"]))
    return joined.withColumn("label", F.when(hit, F.col("label")).otherwise(code)).select(*cells.columns)
