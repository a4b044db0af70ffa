"""Range, nearest, as-of, box and polygon joins, all as equi-joins or windows.

A pure range predicate would be planned as a nested loop. Here interval sides are exploded
to the buckets they touch and equi-joined; nearest joins union both sides and look along
the order within a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .objects import written


def point_in_interval(points: DataFrame, intervals: DataFrame, key: str, value: str, lo: str, hi: str, width: float, closed: bool = True) -> DataFrame:
    """Pairs of points and intervals of one key with lo <= value <= hi (or < hi); each pair once."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    spread = intervals.filter(F.col(lo) <= F.col(hi)).withColumn("__b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    joined = points.withColumn("__b", bucket(value)).join(spread, [key, "__b"]).drop("__b")
    upper = F.col(value) <= F.col(hi) if closed else F.col(value) < F.col(hi)
    return joined.filter((F.col(value) >= F.col(lo)) & upper)


def box_overlap(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of boxes a(x0, x1, y0, y1) and b(bx0, bx1, by0, by1) of one key that touch or overlap; each pair once.

    Both sides are exploded to blocks of pings; a pair is kept in its first shared block only.
    """
    block = lambda c: F.floor(F.col(c) / width).cast("int")
    left = a.filter("x0 <= x1").withColumn("__b", F.explode(F.sequence(block("x0"), block("x1"))))
    right = b.filter("bx0 <= bx1").withColumn("__b", F.explode(F.sequence(block("bx0"), block("bx1"))))
    first = F.greatest(block("x0"), block("bx0")) == F.col("__b")
    hit = (F.col("x0") <= F.col("bx1")) & (F.col("bx0") <= F.col("x1")) & (F.col("y0") <= F.col("by1")) & (F.col("by0") <= F.col("y1"))
    return left.join(right, [key, "__b"]).filter(first & hit).drop("__b")


#: Seconds of a bucket of as-of joins.
BUCKET = 3600.0


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def around_in_time(queries: DataFrame, points: DataFrame, key: str, width: float = BUCKET) -> DataFrame:
    """queries(key, query_id, time) with `before` and `after`: the nearest points(key, t, tie, value) at or before and at or after the time.

    Of points at one time the smallest tie counts; both sides are structs (t, tie, value), null where there is
    none. Both sides are dealt into buckets of `width` seconds and ordered there; a bucket's first and last
    point are carried to the others by one row per bucket. So a key of any length is many tasks,
    and no pair of a query and a point is formed but the two neighbours.
    """
    kind = points.select(F.struct("t", "tie", "value").alias("p")).schema["p"].dataType
    bucket = lambda c: F.floor(_micros(F.col(c)) / F.lit(width * 1e6)).alias("__b")
    none = F.lit(None)
    both = points.select(key, bucket("t"), F.col("t").alias("__t"), F.struct("t", "tie", "value").alias("__p"), none.cast("bigint").alias("query_id"), F.lit(0).alias("__side")).unionByName(
        queries.select(key, bucket("time"), F.col("time").alias("__t"), none.cast(kind).alias("__p"), F.col("query_id").cast("bigint").alias("query_id"), F.lit(1).alias("__side"))
    )
    # null points of queries are left out by the aggregates
    edges = both.groupBy(key, "__b").agg(F.min("__p").alias("__first"), F.max_by("__p", F.when(F.col("__p").isNotNull(), F.struct("__p.t", -F.col("__p.tie")))).alias("__last"))
    up = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(key).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(key, "__b", F.last("__last", True).over(up).alias("__from"), F.last("__first", True).over(down).alias("__to"))
    inside = Window.partitionBy(key, "__b")
    forward = inside.orderBy("__t", "__side", F.desc("__p.tie"))
    backward = inside.orderBy(F.desc("__t"), "__side", F.desc("__p.tie"))
    seen = both.withColumns({"before": F.last("__p", True).over(forward), "after": F.last("__p", True).over(backward)}).filter("__side = 1")
    return seen.join(edges, [key, "__b"]).select(key, "query_id", F.col("__t").alias("time"), F.coalesce("before", "__from").alias("before"), F.coalesce("after", "__to").alias("after"))


def _points(pings: DataFrame, key: str) -> DataFrame:
    return pings.select(key, F.col("ping_time").alias("t"), F.col("ping_idx").alias("tie"), F.col("ping_idx").alias("value"))


def nearest_in_time(queries: DataFrame, pings: DataFrame, key: str = "raw_file", width: float = BUCKET) -> DataFrame:
    """queries(key, query_id, time), pings(key, ping_idx, ping_time) -> query_id, ping_idx, the earlier ping on a tie."""
    seen = around_in_time(queries, _points(pings, key), key, width)
    gap = lambda c: F.abs(_micros(F.col(f"{c}.t")) - _micros(F.col("time")))
    take_after = F.col("before").isNull() | (gap("after") < gap("before"))
    return seen.select(key, "query_id", F.when(take_after, F.col("after.value")).otherwise(F.col("before.value")).alias("ping_idx"))


def first_at_or_after(queries: DataFrame, pings: DataFrame, key: str = "raw_file", width: float = BUCKET) -> DataFrame:
    """queries(key, query_id, time) -> the first ping with ping_time >= time, for times within the key's pings."""
    seen = around_in_time(queries, _points(pings, key), key, width)
    return seen.filter("before is not null and after is not null").select(key, "query_id", F.col("after.value").alias("ping_idx"))


def interpolated_in_time(queries: DataFrame, values: DataFrame, key: str = "raw_file", width: float = BUCKET) -> DataFrame:
    """queries(key, query_id, time), values(key, t, v) -> v linearly interpolated at time; null outside the values."""
    points = values.select(key, "t", F.col("v").cast("double").alias("tie"), F.col("v").cast("double").alias("value"))
    seen = around_in_time(queries, points, key, width)
    at = lambda c: _micros(F.col(c))
    share = F.try_divide((at("time") - at("before.t")).cast("double"), (at("after.t") - at("before.t")).cast("double"))
    between = F.col("before.value") + share * (F.col("after.value") - F.col("before.value"))
    return seen.select(key, "query_id", F.when(F.col("before.t") == F.col("after.t"), F.col("before.value")).otherwise(between).alias("v"))


#: Positions of a cell that a position shares it with, on average, beyond which cells of nearest_position are halved.
CROWD = 8


def nearest_position(points: DataFrame, pings: DataFrame, cell: float, rings: int = 1) -> DataFrame:
    """points(point_id, lat, lon) -> nearest ping by Euclidean degrees among pings(ping_id, lat, lon); missing positions are skipped.

    Pings at one position are one candidate, the one with the smallest id. They are dealt into square
    cells of `cell` degrees, or of halves of it where these would be crowded, so the pairs that are
    formed grow with the points, not with their density. A point looks at its own and the neighbouring
    cells, which is exact for pings within rings cells. Points without such a ping go down
    from the largest cells, at any distance. Points without a position get a null.
    """
    own = pings.filter(~F.isnan("lat") & ~F.isnan("lon")).groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min("ping_id").alias("ping_id"))
    own = written(own)
    cell = _uncrowded(own, cell)
    at = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("int")
    ok = own.select("ping_id", "plat", "plon", at("plat").alias("gy"), at("plon").alias("gx"))
    span = F.sequence(F.lit(-rings), F.lit(rings))
    spread = points.withColumn("dy", F.explode(span)).withColumn("dx", F.explode(span)).withColumn("gy", at("lat") + F.col("dy")).withColumn("gx", at("lon") + F.col("dx"))
    best = spread.join(ok, ["gy", "gx"]).withColumn("d2", _d2()).filter(F.col("d2") <= F.lit((rings * cell) ** 2)).groupBy("point_id").agg(F.min_by("ping_id", F.struct("d2", "ping_id")).alias("ping_id"))
    best = written(best)
    far = points.filter(~F.isnan("lat") & ~F.isnan("lon")).select("point_id", "lat", "lon").join(best, "point_id", "left_anti")
    if not far.isEmpty():
        best = best.unionByName(_nearest_far(far, ok, cell))
    return points.select("point_id").join(best, "point_id", "left")


def _uncrowded(positions: DataFrame, cell: float, halvings: int = 16) -> float:
    """cell, halved until a position shares its cell with at most CROWD positions on average."""
    for _ in range(halvings):
        counts = positions.groupBy(F.floor(F.col("plat") / F.lit(cell)), F.floor(F.col("plon") / F.lit(cell))).agg(F.count("*").cast("double").alias("n"))
        crowd = counts.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).first().m
        if crowd is None or crowd <= CROWD:
            break
        cell /= 2
    return cell


def _d2() -> Column:
    return F.pow(F.col("plat") - F.col("lat"), 2) + F.pow(F.col("plon") - F.col("lon"), 2)


def _nearest_far(points: DataFrame, ok: DataFrame, cell: float) -> DataFrame:
    """point_id and nearest ping_id at any distance, from cells that halve down to `cell`.

    At each size a point keeps the cells that may hold a ping as near as the nearest ping seen so
    far, one of each cell, so it meets single pings in the last few cells only.
    """
    end = ok.agg(F.min("gy").alias("y0"), F.max("gy").alias("y1"), F.min("gx").alias("x0"), F.max("gx").alias("x1")).first()
    if end.y0 is None:
        return points.select("point_id", F.lit(None).cast(ok.schema["ping_id"].dataType).alias("ping_id"))
    level = max(end.y1 - end.y0, end.x1 - end.x0).bit_length()
    fine = ok.groupBy("gy", "gx").agg(F.min_by(F.struct("plat", "plon"), "ping_id").alias("p"))
    side = lambda lo, hi: F.explode(F.sequence(F.lit(lo >> level), F.lit(hi >> level)))
    near = points.withColumn("cy", side(end.y0, end.y1)).withColumn("cx", side(end.x0, end.x1))
    while True:
        up = [F.shiftright(c, level).alias(f"c{c[1]}") for c in ("gy", "gx")]
        cells = fine.groupBy(*up).agg(F.min_by("p", F.struct("gy", "gx")).alias("p")).select("cy", "cx", "p.*")
        size = cell * 2**level
        off = lambda v, c: F.greatest(F.col(c) * F.lit(size) - F.col(v), F.col(v) - (F.col(c) + 1) * F.lit(size), F.lit(0.0))  # noqa: B023,E731
        # rounding of the cells' borders must not lose a ping
        least = F.pow(F.greatest(F.hypot(off("lat", "cy"), off("lon", "cx")) - F.lit(1e-9), F.lit(0.0)), 2)
        seen = near.join(cells, ["cy", "cx"]).withColumn("least", least).withColumn("best", F.min(_d2()).over(Window.partitionBy("point_id")))
        near = seen.filter("least <= best").select("point_id", "lat", "lon", "cy", "cx")
        if not level:
            break
        level -= 1
        half = F.explode(F.array(F.lit(0), F.lit(1)))
        near = near.withColumn("hy", half).withColumn("hx", half).select("point_id", "lat", "lon", (F.col("cy") * 2 + F.col("hy")).alias("cy"), (F.col("cx") * 2 + F.col("hx")).alias("cx"))
    hit = near.withColumnsRenamed({"cy": "gy", "cx": "gx"}).join(ok, ["gy", "gx"]).withColumn("d2", _d2())
    return hit.groupBy("point_id").agg(F.min_by("ping_id", F.struct("d2", "ping_id")).alias("ping_id"))


def objects_with_seabed(objects: DataFrame, seabed: DataFrame) -> DataFrame:
    """objects with distance_to_seabed at their centre ping and valid_object; invalid ones have no distance."""
    centre = (F.col("x0") + ((F.col("x1") - F.col("x0")) / 2).cast("int")).cast("int")
    joined = objects.withColumn("ping_idx", centre).join(seabed.select("raw_file", "ping_idx", "seabed_idx"), ["raw_file", "ping_idx"], "left")
    valid = (F.col("x0") <= F.col("x1")) & (F.col("category") != -1)
    return joined.select(*objects.columns, F.when(valid, (F.col("seabed_idx") - F.col("y1")).cast("double")).alias("distance_to_seabed"), valid.alias("valid_object"))


def fish_schools(objects: DataFrame, categories: list[int] | None = None) -> DataFrame:
    """Valid objects of these categories, or of any but -1."""
    kind = F.col("category") != -1 if categories is None else F.col("category").isin(categories)
    return objects.filter(kind & F.col("valid_object"))


def depth_bins(low: Column, high: Column, first: float, step: float, n: int) -> tuple[Column, Column]:
    """Bins [a, b) of an even range grid: the first bin deeper than low, the first deeper than high; empty beyond the grid."""
    index = lambda d: F.greatest(F.floor((d - first) / step).cast("int") + 1, F.lit(0))
    inside = lambda i: F.when(i >= n, 0).otherwise(i)
    return inside(index(low)), inside(index(high))


def align_channels(sv: DataFrame, main_hz: int) -> DataFrame:
    """Channels aligned in time: key = round(t / tolerance) with the main channel's smallest step as tolerance.

    Every key of any channel has a row for every channel; a missing ping is a profile of NaN. What is known of a file
    is one row and broadcast, and all channels of a key are gathered in one row, so profiles are shuffled once.
    """
    order = Window.partitionBy("raw_file").orderBy("t")
    main = sv.filter(F.col("freq_hz") == main_hz).withColumn("d", F.col("t") - F.lag("t").over(order))
    tol = main.filter("d > 0").groupBy("raw_file").agg(F.min("d").alias("tol"))
    channels = sv.groupBy("raw_file").agg(F.collect_set("freq_hz").alias("f"), F.max(F.size("sv")).alias("n"))
    files = F.broadcast(tol.join(channels, "raw_file"))
    keyed = sv.join(F.broadcast(tol), "raw_file").withColumn("k", F.rint(F.col("t") / F.col("tol")).cast("bigint"))
    # sorted by time, so that the first row of a channel is its earliest
    near = keyed.groupBy("raw_file", "k").agg(F.sort_array(F.collect_list(F.struct("t", "freq_hz", "sv"))).alias("__rows"))
    each = near.join(files, "raw_file").select("raw_file", "k", F.explode("f").alias("freq_hz"), "n", "__rows")
    got = F.get(F.filter("__rows", lambda x: x["freq_hz"] == F.col("freq_hz")), F.lit(0))["sv"]
    return each.select("raw_file", "k", "freq_hz", F.coalesce(got, F.array_repeat(F.lit(float("nan")), F.col("n"))).alias("sv"))


def cells_in_polygons(polygons: DataFrame, cells: DataFrame, n_range: int | None = None) -> DataFrame:
    """polygons(raw_file, polygon_id, category, xs, ys), cells(raw_file, ping_idx, r) -> cells inside or on an edge.

    Edges are exploded to the pings that they cross and equi-joined; a cell is inside by the
    parity of crossings above it. A later polygon (larger id) wins. With n_range, cells are pings
    (raw_file, ping_idx) of that many bins; they meet the edges first and get the bins of a polygon's
    depth after that. Neither side is broadcast: what an explosion makes of a small table is not small.
    """
    n = F.size("xs")
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("xs", i).alias("xa"), F.get("ys", i).alias("ya"), F.get("xs", (i + 1) % n).alias("xb"), F.get("ys", (i + 1) % n).alias("yb")))
    edges = polygons.filter(n > 2).select("raw_file", "polygon_id", "category", F.array_min("ys").alias("top"), F.array_max("ys").alias("low"), F.explode(edge).alias("g")).select("raw_file", "polygon_id", "category", "top", "low", "g.*")
    edges = edges.withColumn("ping_idx", F.explode(F.sequence(F.ceil(F.least("xa", "xb")).cast("int"), F.floor(F.greatest("xa", "xb")).cast("int"))))
    met = cells.join(edges.hint("merge"), ["raw_file", "ping_idx"])
    if n_range is not None:
        first, last = F.greatest(F.floor("top").cast("int") - 1, F.lit(0)), F.least(F.ceil("low").cast("int") + 1, F.lit(n_range - 1))
        met = met.filter(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    x, y = F.col("ping_idx"), F.col("r")
    at = F.col("ya") + F.try_divide((x - F.col("xa")) * (F.col("yb") - F.col("ya")), F.col("xb") - F.col("xa"))
    crosses = (((F.col("xa") > x) != (F.col("xb") > x)) & (y < at)).cast("int")
    on_line = F.when(F.col("xa") == F.col("xb"), (y >= F.least("ya", "yb")) & (y <= F.greatest("ya", "yb"))).otherwise(F.abs(y - at) < 1e-9)
    hit = met.groupBy("raw_file", "ping_idx", "r", "polygon_id", "category").agg((F.sum(crosses) % 2).alias("odd"), F.max(on_line.cast("int")).alias("edge"))
    return hit.filter("odd = 1 or edge = 1").groupBy("raw_file", "ping_idx", "r").agg(F.max_by("category", "polygon_id").alias("category"))


#: Labels whose cells a patch does not return: overlap, seabed, border.
NOT_RETURNED = (-70, -50, -100)


def scatter_cells(patches: DataFrame, fields: Sequence[str], pings: DataFrame | None = None, ignored: Sequence[int] = NOT_RETURNED) -> DataFrame:
    """Patch cells(raw_file, ping_idx, r, label, fields) -> raw_file, ping_idx, cells[(r, fields)] of the cells that count, sorted by r.

    A ping without such a cell has an empty list: of pings(raw_file, ping_idx), or else of the pings of patches.
    """
    kept = patches.filter(~F.col("label").isin(list(ignored)))
    found = kept.groupBy("raw_file", "ping_idx").agg(F.sort_array(F.collect_list(F.struct("r", *fields))).alias("cells"))
    every = (patches if pings is None else pings).select("raw_file", "ping_idx").distinct()
    empty = F.array().cast(found.schema["cells"].dataType)
    return every.join(found, ["raw_file", "ping_idx"], "left").withColumn("cells", F.coalesce("cells", empty))


def scatter_predictions(patches: DataFrame, pings: DataFrame | None = None, ignored: Sequence[int] = NOT_RETURNED) -> DataFrame:
    """scatter_cells of the scores p_sandeel and p_other."""
    return scatter_cells(patches, ["p_sandeel", "p_other"], pings, ignored)


def scatter_labels(patches: DataFrame, n: int, pings: DataFrame | None = None, ignored: Sequence[int] = NOT_RETURNED) -> DataFrame:
    """Patch cells(raw_file, ping_idx, r, label) -> raw_file, ping_idx, labels of n bins, 0 where no cell is returned."""
    found = scatter_cells(patches, ["label"], pings, ignored)
    return found.select("raw_file", "ping_idx", F.transform(dense_profile("cells", "label", n), lambda y: y.cast("int")).alias("labels"))


def dense_profile(cells: Column | str, field: str, n: int) -> Column:
    """An array of n values from entries (r, ...) that ascend in r, 0 in the gaps; one pass over the entries."""
    col = F.col(cells) if isinstance(cells, str) else cells
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    before = lambda i: F.when(i > 0, F.get(col, i - 1)["r"]).otherwise(-1)
    filled = F.flatten(F.transform(col, lambda c, i: F.concat(zeros(c["r"] - before(i) - 1), F.array(c[field]))))
    return F.concat(filled, zeros(F.lit(n - 1) - F.coalesce(F.get(col, F.size(col) - 1)["r"], F.lit(-1))))
