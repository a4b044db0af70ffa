"""Precision-recall evaluation, weighted loss, and object-level matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import acoustic as A
from .blocks import running_sums

CLASS_WEIGHTS = (10.0, 300.0, 250.0)


def precision_recall(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """scored(by, score, positive) -> by, threshold, precision, recall, f1.

    Stage one counts positives per distinct score. The counts are summed from the largest score on
    over ranges of scores, so a curve of any number of points is many tasks. The curve is cut
    at the first full recall and ends with the point (1, 0), whose threshold is null.
    """
    if not by:
        return precision_recall(scored.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    keys = list(by)
    return counted_curve(scored.groupBy(*keys, "score").agg(F.sum(F.col("positive").cast("bigint")).alias("p"), F.count("*").alias("n")), keys)


def counted_curve(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """precision_recall of counts(keys, score, p, n): the positives and all cells of each distinct score."""
    keys = list(keys)
    summed = running_sums(counts, keys, [F.desc("score")], {"tp": "p", "seen": "n"})
    # at the first full recall tp has reached its largest value
    ends = summed.groupBy(*keys).agg(F.max("tp").alias("total"), F.max_by("score", F.struct("tp", "score")).alias("__c"))
    ends = ends.select(*[F.col(k).alias(f"__by_{k}") for k in keys], "total", "__c")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in keys])
    curve = summed.join(ends, same).filter(F.col("total").isNull() | (F.col("score") >= F.col("__c")))
    points = curve.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"), F.try_divide(F.col("tp"), F.col("total")).alias("recall"))
    end = counts.select(*keys).distinct().select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def valid_cells(cells: DataFrame) -> DataFrame:
    """cells(label, score) that count for an evaluation: scores are 0 below the seabed, codes are merged, ignored cells go."""
    out = cells.withColumn("score", A.score_above_seabed(F.col("score"), F.col("label"))).withColumn("label", A.evaluation_label(F.col("label")))
    return out.filter(F.col("label") != A.IGNORE)


@F.arrow_udf(T.ArrayType(T.FloatType()))
def half_precision_profile(profiles: pa.Array) -> pa.Array:
    """acoustic.half_precision of every cell of a profile, as floats, which hold these numbers as they are; whole Arrow batches at once."""
    flat = profiles.flatten()
    half = flat.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
    cells = pa.array(half, mask=pc.is_null(flat).to_numpy(zero_copy_only=False))
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(profiles), 0).to_numpy(zero_copy_only=False)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.r_[pc.is_null(profiles).to_numpy(zero_copy_only=False), False]), cells)


def _mask_counts(height: int):
    """Columns of patches with what their ping has of boxes and scores -> survey, mode, compat, score, p, n of a batch."""

    def lists(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The size of each list, its row for each element, and the elements."""
        size = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return size, np.repeat(np.arange(len(size)), size), a.flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            labels = batch.column("labels").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, height)
            top = batch.column("top").to_numpy(zero_copy_only=False)
            size, row, flat = lists(batch.column("p"))
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            scores, known = np.zeros((n, max(int(size.max()), 1))), np.zeros((n, max(int(size.max()), 1)), dtype=bool)
            scores[row, at] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
            known[row, at] = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            r = top[:, None] + np.arange(height)
            inside = (r >= 0) & (r < scores.shape[1])
            r = np.clip(r, 0, scores.shape[1] - 1)
            score, inside = np.take_along_axis(scores, r, 1), inside & np.take_along_axis(known, r, 1)
            # what the spans of a ping cover of its column: steps up and down, summed
            _, row, spans = lists(batch.column("spans"))
            steps = np.zeros((n, height + 1), dtype=np.int64)
            for edge, step in (("lo", 1), ("hi", -1)):
                np.add.at(steps, (row, np.clip(spans.field(edge).to_numpy(zero_copy_only=False) - top[row], 0, height)), step)
            trace = batch.column("mode").to_numpy(zero_copy_only=False) == "trace"
            near = pc.fill_null(batch.column("near"), False).to_numpy(zero_copy_only=False)
            hit = np.where(trace[:, None], near[:, None], np.cumsum(steps, axis=1)[:, :height] > 0)
            survey, survey_at = np.unique(batch.column("survey").to_numpy(zero_copy_only=False), return_inverse=True)
            group = np.broadcast_to((survey_at * 2 + trace)[:, None], hit.shape)
            for compat, code in ((False, A.IGNORE), (True, -1)):
                y = np.where(hit, labels, code)
                counts = inside & ~np.isin(y, (A.OVERLAP, A.BORDER, A.IGNORE, A.OTHER))
                value, value_at = np.unique(np.where(y == A.SEABED, 0.0, score)[counts], return_inverse=True)
                key = group[counts] * len(value) + value_at
                total = np.bincount(key, minlength=1)
                hits = np.bincount(key, weights=(y == 1)[counts], minlength=len(total)).astype(np.int64)
                k = np.flatnonzero(total)
                g = k // max(len(value), 1)
                yield pa.RecordBatch.from_pydict(
                    {"survey": pa.array(survey[g // 2], pa.int32()), "mode": np.where(g % 2 == 1, "trace", "region").tolist(), "compat": [compat] * len(k), "score": value[k % max(len(value), 1)], "p": hits[k], "n": total[k].astype(np.int64)},
                    schema=pa.schema([("survey", pa.int32()), ("mode", pa.string()), ("compat", pa.bool_()), ("score", pa.float64()), ("p", pa.int64()), ("n", pa.int64())]),
                )

    return run


def masked_counts(columns: DataFrame, spans: DataFrame, pings: DataFrame, scores: DataFrame, height: int) -> DataFrame:
    """columns(mode, raw_file, ping_idx, top, labels) of evaluated patches -> survey, mode, compat, score, p, n: cells and positives of each score.

    A cell of mode region keeps its label within spans(labels.object_spans), one of mode trace on pings(labels.object_pings); other
    cells are ignored, or negatives with compat. What counts, and its score, is as in valid_cells. Columns, not cells, meet the
    boxes and scores(survey, raw_file, ping_idx, p) of their ping; no side is broadcast. Cells are counted within Arrow batches.
    """
    keys = ["raw_file", "ping_idx"]
    rows = columns.join(scores.hint("merge"), keys).join(spans.hint("merge"), keys, "left").join(pings.withColumn("near", F.lit(True)).hint("merge"), keys, "left")
    counts = rows.select("survey", "mode", "top", "labels", "p", "spans", "near").mapInArrow(_mask_counts(height), "survey int, mode string, compat boolean, score double, p long, n long")
    return counts.groupBy("survey", "mode", "compat", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def best_f1(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The point with the largest F1, at the smallest threshold of equals."""
    point = F.struct(-F.col("f1"), F.col("threshold"))
    cols = [F.min_by(c, point).alias(c) for c in ("threshold", "precision", "recall", "f1")]
    rows = curve.filter("threshold is not null")
    return rows.groupBy(*by).agg(*cols)


def weighted_loss(cells: DataFrame, weights: Sequence[float] = CLASS_WEIGHTS, ignore: int = -100) -> DataFrame:
    """cells(batch, label, p0, p1, p2) -> loss: mean over batches of the class-weighted mean of -ln p[label]."""
    w, p = F.array(*map(F.lit, weights)), F.array("p0", "p1", "p2")
    kept = cells.filter(F.col("label") != ignore).select("batch", F.get(w, F.col("label")).alias("w"), F.get(p, F.col("label")).alias("p"))
    each = kept.groupBy("batch").agg((F.sum(-F.col("w") * F.log("p")) / F.sum("w")).alias("loss"))
    return each.agg(F.avg("loss").alias("loss"))


#: Area ranges of objects (inclusive) and the largest number of detections of a file and category that are served.
AREAS = {"all": (0, 1e10), "small": (0, 32**2), "medium": (32**2, 96**2), "large": (96**2, 1e10)}
MAX_FOUND = 100


def box_pairs(truth: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """raw_file, category, det_id, score, found_area, object_id, truth_area, iou of overlapping boxes of one category, with inclusive corners."""
    from .joins import box_overlap

    pairs = box_overlap(truth.select("raw_file", "category", "object_id", "x0", "x1", "y0", "y1"), found.withColumnRenamed("category", "__cat"), "raw_file", width).filter("category = __cat")
    side = lambda a, b, c, d: F.greatest(F.least(b, d) - F.greatest(a, c) + 1, F.lit(0))
    inter = side(F.col("x0"), F.col("x1"), F.col("bx0"), F.col("bx1")) * side(F.col("y0"), F.col("y1"), F.col("by0"), F.col("by1"))
    return pairs.select("raw_file", "category", "det_id", "score", "object_id", box_area("bx0", "bx1", "by0", "by1").alias("found_area"), box_area("x0", "x1", "y0", "y1").alias("truth_area"), inter.alias("__i")).withColumn(
        "iou", F.col("__i") / (F.col("found_area") + F.col("truth_area") - F.col("__i"))
    ).drop("__i")


def box_area(x0: str, x1: str, y0: str, y1: str) -> Column:
    return (F.col(x1) - F.col(x0) + 1) * (F.col(y1) - F.col(y0) + 1)


def _serve(areas: dict[str, tuple[float, float]], thresholds: Sequence[float]):
    """The pairs of one file and category -> area, threshold, det_id, object_id, iou, ignored of the detections that take a truth."""

    def run(table: pa.Table) -> pa.Table:
        det, truth, iou, score, size = (table.column(c).to_numpy() for c in ("det_id", "object_id", "iou", "score", "truth_area"))
        order = np.lexsort((truth, det, -score))
        cuts = np.flatnonzero(np.r_[True, det[order][1:] != det[order][:-1], True])
        out: dict[str, list] = {c: [] for c in ("area", "threshold", "det_id", "object_id", "iou", "ignored")}
        for name, (lo, hi) in areas.items():
            outside = (size < lo) | (size > hi)
            for t in thresholds:
                taken: set[int] = set()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    free = [i for i in order[a:b].tolist() if iou[i] >= t and int(truth[i]) not in taken]
                    if free:
                        # truths that count go before ignored ones, then the largest overlap, then the smaller id
                        best = min(free, key=lambda i: (outside[i], -iou[i], truth[i]))
                        taken.add(int(truth[best]))
                        for c, v in zip(out, (name, t, int(det[best]), int(truth[best]), float(iou[best]), bool(outside[best])), strict=True):
                            out[c].append(v)
        return pa.table({"area": pa.array(out["area"], pa.string()), "threshold": pa.array(out["threshold"], pa.float64()), "det_id": pa.array(out["det_id"], pa.int64()), "object_id": pa.array(out["object_id"], pa.int64()), "iou": pa.array(out["iou"], pa.float64()), "ignored": pa.array(out["ignored"], pa.bool_())})

    return run


def served_boxes(pairs: DataFrame, areas: dict[str, tuple[float, float]], thresholds: Sequence[float]) -> DataFrame:
    """box_pairs -> area, threshold, det_id, object_id, iou, ignored: who takes whom in each area range and at each least overlap.

    Detections are served by score, the smaller det_id first among equals: each takes the best truth
    that no earlier one has taken. Only boxes of one file and category meet, so these are the
    groups; each is served in one pass, however long its chains of overlaps.
    """
    return pairs.groupBy("raw_file", "category").applyInArrow(_serve(areas, thresholds), "area string, threshold double, det_id long, object_id long, iou double, ignored boolean")


def match_boxes(truth: DataFrame, found: DataFrame, width: int, threshold: float = 0.5) -> DataFrame:
    """found(raw_file, category, det_id, score, bx0..by1) with iou and is_match against truth(raw_file, category, object_id, x0..y1), as served_boxes matches them. Ids are unique over all files."""
    won = served_boxes(box_pairs(truth, found, width), {"all": (float("-inf"), float("inf"))}, [threshold]).select("det_id", "iou")
    return found.join(won.withColumn("is_match", F.lit(True)), "det_id", "left").withColumn("is_match", F.coalesce("is_match", F.lit(False)))


def average_precision(truth: DataFrame, found: DataFrame, width: int, thresholds: Sequence[float] = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95), areas: dict[str, tuple[float, float]] = AREAS, most: int = MAX_FOUND) -> DataFrame:
    """category, area, threshold, n (truths that count), ap: the mean over recalls 0, 0.01, .. 1 of the best precision at that recall or beyond.

    Truths outside an area range are ignored, and with them what takes them; so are detections outside the
    range that take nothing. Of a file and category the `most` best detections are served. Categories without a
    truth in the range have no row. Detections of a category are ranked over ranges of scores; the best
    precision is kept per hundredth of recall first, so the envelope is taken over at most 101
    rows of a category.
    """
    first = Window.partitionBy("raw_file", "category").orderBy(F.desc("score"), "det_id")
    best = found.withColumn("__k", F.row_number().over(first)).filter(F.col("__k") <= most).drop("__k")
    levels = F.explode(F.array(*[F.struct(F.lit(n).alias("area"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, (lo, hi) in areas.items()])).alias("a")
    inside = F.col("size").between(F.col("a.lo"), F.col("a.hi"))
    counts = truth.select("category", box_area("x0", "x1", "y0", "y1").alias("size"), levels).groupBy("category", F.col("a.area").alias("area")).agg(F.count_if(inside).alias("n")).filter("n > 0")
    won = served_boxes(box_pairs(truth, best, width), areas, thresholds).select("area", "threshold", "det_id", "ignored")
    asked = best.select("category", "det_id", "score", box_area("bx0", "bx1", "by0", "by1").alias("size"), levels).select("category", "det_id", "score", F.col("a.area").alias("area"), (~inside).alias("outside"))
    asked = asked.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    judged = asked.join(won, ["area", "threshold", "det_id"], "left").filter(~F.coalesce("ignored", "outside"))
    keys = ["category", "area", "threshold"]
    curve = running_sums(judged.withColumn("hit", F.col("ignored").isNotNull().cast("long")), keys, [F.desc("score"), F.col("det_id")], {"tp": "hit", "seen": F.lit(1)})
    # recall in whole hundredths, rounded down: the points that reach k / 100 are those of hundredth k and beyond
    points = curve.join(counts, ["category", "area"]).groupBy(*keys, F.expr("100 * tp div n").alias("k")).agg(F.max(F.col("tp") / F.col("seen")).alias("precision"))
    envelope = points.groupBy(*keys).agg(F.collect_list(F.struct("k", "precision")).alias("points"))
    at = lambda k: F.coalesce(F.array_max(F.transform(F.filter("points", lambda p: p["k"] >= k), lambda p: p["precision"])), F.lit(0.0))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(100)), at), F.lit(0.0), lambda a, x: a + x)
    each = counts.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return each.join(envelope, keys, "left").select(*keys, "n", F.coalesce(total / 101, F.lit(0.0)).alias("ap"))
