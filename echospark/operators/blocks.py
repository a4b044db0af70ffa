"""Work along long sequences of pings in blocks of bounded size, with halo rows and carried edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pings in a block.
BLOCK = 4096


@dataclass(frozen=True)
class BlockTable:
    """A stored table of pings in blocks, as with_halo deals them: work on blocks finds all their rows in one bucket and shuffles none of them."""

    #: raw_file, block, own, ping_idx, end (the first or the last ping of a file) and further columns, in `buckets` buckets of (raw_file, block).
    rows: DataFrame
    size: int
    halo: int
    buckets: int

    def table(self) -> DataFrame:
        """Every row once, without blocks."""
        return self.rows.filter("own").drop("block", "own", "end")


def survey_position(rows: DataFrame, pings: DataFrame | None = None) -> DataFrame:
    """rows(survey, raw_file, ping_idx) with `position`: the place of a ping in its survey, file after file.

    Pings of a file are numbered from 0. The offsets of files are sums over one row per file;
    no window runs over pings. pings (default rows) has every ping of the surveys.
    """
    files = (rows if pings is None else pings).groupBy("survey", "raw_file").agg((F.max("ping_idx") + 1).alias("__n"))
    before = Window.partitionBy("survey").orderBy("raw_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("survey", "raw_file", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__start"))
    return rows.join(starts, ["survey", "raw_file"]).withColumn("position", F.col("__start") + F.col("ping_idx")).drop("__start")


def with_halo(rows: DataFrame, position: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """rows once for each block that they stand in or near: `block`, and `own` for the rows that belong to it.

    A block has the `before` positions ahead of its first own row and the `after` positions behind its last one.
    """
    p, n = F.col(position).cast("long"), F.lit(size)
    at = F.sequence(F.greatest(F.floor((p - after) / n), F.lit(0)), F.floor((p + before) / n))
    out = rows.withColumn("block", F.explode(at))
    return out.withColumn("own", F.col("block") == F.floor(p / n))


def nearest_known(rows: DataFrame, keys: Sequence[str], position: str, known: Column, value: Column, size: int = BLOCK) -> DataFrame:
    """rows with `before` and `after`: (at, value) of the nearest rows with `known` ahead of and behind each row; and `last`, the largest position.

    Windows run within blocks; what crosses their edges is carried by one row per block.
    """
    item = F.struct(F.col(position).cast("long").alias("at"), value.alias("value"))
    own = rows.withColumn("__block", F.floor(F.col(position) / F.lit(size))).withColumn("__item", F.when(known, item))
    edges = own.groupBy(*keys, "__block").agg(F.min("__item").alias("__first"), F.max("__item").alias("__last"), F.max(position).alias("__end"))
    order = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumns(
        {
            "__before": F.last("__last", ignorenulls=True).over(order),
            "__after": F.last("__first", ignorenulls=True).over(back),
            "last": F.max("__end").over(Window.partitionBy(*keys)),
        }
    ).drop("__first", "__last", "__end")
    inside = Window.partitionBy(*keys, "__block")
    up = inside.orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    down = inside.orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"before": F.last("__item", ignorenulls=True).over(up), "after": F.last("__item", ignorenulls=True).over(down)})
    out = own.join(edges, [*keys, "__block"])
    out = out.withColumns({"before": F.coalesce("before", "__before"), "after": F.coalesce("after", "__after")})
    return out.drop("__block", "__item", "__before", "__after")


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: dict[str, Column | str]) -> DataFrame:
    """rows with one column per name in `values`: its sum over the rows of the same `by` up to this one, in `order`.

    The order is total within `by`: rows of equal order stand in one range and share nothing else
    that is promised. Rows are dealt into ranges of (by, order), each range is summed on its own, and
    the sums of earlier ranges are carried by one row for each range and `by`; so a group of
    any size is many tasks. Values must not be null.
    """
    from .objects import written

    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = rows.withColumns({f"__{k}": c if isinstance(c, Column) else F.col(c) for k, c in values.items()})
    placed = written(placed.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__range", F.spark_partition_id()))
    totals = placed.groupBy(*by, "__range").agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in values])
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__of"), *[F.coalesce(F.sum(f"__t_{k}").over(ahead), F.lit(0)).alias(f"__c_{k}") for k in values])
    upto = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"__{k}": F.sum(f"__{k}").over(upto) for k in values})
    same = F.col("__range") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return summed.join(carried, same).select(*rows.columns, *[(F.col(f"__{k}") + F.col(f"__c_{k}")).alias(k) for k in values])


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """rows with their place (from 0) in the total `order` within `by`, without a window over a whole group."""
    return running_sums(rows, by, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)
