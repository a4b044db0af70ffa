"""Operator 11: periodic runs of words by block convolution.

A run is a stretch of words with smallest period q (words q apart are identical) that is at
least max(`min_words`, `exponent` * q) long and that no neighbouring word extends.

Method. The words of a slice of texts become integers, texts divided by integers of their own.
At every dyadic scale B the integers are cut into blocks of B. For each block the sums of
squared differences to all its shifts by B to 2B - 1 words (1 to 2B - 1 at the smallest scale)
come from one cyclic convolution of length 2B, by a number theoretic transform modulo a prime:
sum of squares of the block, plus that of the window, minus twice their product. A sum that
is zero is an occurrence of the block, exactly: where the sums may exceed the prime, a second
prime is taken, and occurrences are confirmed on the words. Distances of occurrences seed
stretches that are extended word by word on both sides.

No run is lost. A run of period q holds 2B - 1 + q words or more at the scale with B <= q < 2B
(for `exponent` 3 and 24 words), so it holds a whole block and its next occurrence. Blocks of
which some word does not recur within 2B - 1 words have no occurrence there and need no
convolution. A seed inside a known run whose period divides its distance gives that run again
and is passed over, so a text of one word alone costs no more than n log n.

Scale. One pass over the texts without a shuffle; a text is worked on in one task, in memory
in proportion to it. Blocks are transformed in batches of bounded size.

Edge cases. A null, empty or blank text has no words and no runs; its collapsed text is empty.
Repeated rows and repeated or null doc_ids are rows of their own. An empty table gives an empty
result. Other columns are ignored, whatever their names. The registered query rewrites texts by
the checksum of the doc_id, as its contract says; a row without a doc_id is not rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MIN_WORDS, EXPONENT = 24, 3
#: Primes with roots of unity of order 2**26 and more, and a primitive root of each.
PRIMES = ((2013265921, 31), (1811939329, 13))
#: Numbers in a batch of transforms.
ROOM = 1 << 18
U64 = np.uint64


@lru_cache(maxsize=128)
def _roots(p: int, g: int, n: int) -> np.ndarray:
    """The first n / 2 powers of a primitive n-th root of unity modulo p."""
    out, root = np.ones(max(n // 2, 1), dtype=U64), pow(g, (p - 1) // n, p)
    size = 1
    while size < len(out):
        out[size : 2 * size] = out[:size] * U64(pow(root, size, p)) % U64(p)
        size *= 2
    return out


def transform(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """The number theoretic transform of each row of x (a power of two long), in bit-reversed order."""
    rows, n = x.shape
    out, half, q = x.astype(U64), n // 2, U64(p)
    while half:
        v = out.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1]
        out = np.stack([(a + b) % q, (a + q - b) * _roots(p, g, 2 * half) % q], axis=2).reshape(rows, n)
        half //= 2
    return out


def inverse(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """The inverse of transform(), from bit-reversed to natural order."""
    rows, n = x.shape
    out, half, q, back = x, 1, U64(p), pow(g, -1, p)
    while half < n:
        v = out.reshape(rows, -1, 2, half)
        a, b = v[:, :, 0], v[:, :, 1] * _roots(p, back, 2 * half) % q
        out = np.stack([(a + b) % q, (a + q - b) % q], axis=2).reshape(rows, n)
        half *= 2
    return out * U64(pow(n, -1, p)) % q


def squared_differences(blocks: np.ndarray, windows: np.ndarray, shifts: int, p: int, g: int) -> np.ndarray:
    """For each row, the sum of squared differences of the block to its window from 0 .. shifts - 1 on, modulo p.

    The window is at least shifts + B - 1 long, and the transform as long as the window rounded up.
    """
    rows, size = blocks.shape
    n, q = 1 << (windows.shape[1] - 1).bit_length(), U64(p)
    pad = lambda x: np.pad(x.astype(U64) % q, ((0, 0), (0, n - x.shape[1])))
    x, y = pad(blocks), pad(windows)
    # the block backwards in the cyclic group turns the convolution into a correlation
    mirrored = np.concatenate([x[:, :1], x[:, :0:-1]], axis=1)
    product = inverse(transform(mirrored, p, g) * transform(y, p, g) % q, p, g)[:, :shifts]
    sums = np.zeros((rows, n + 1), dtype=U64)
    np.cumsum(y * y % q, axis=1, out=sums[:, 1:])
    of_window = (sums[:, size : size + shifts] - sums[:, :shifts]) % q
    of_block = (x * x % q).sum(axis=1, keepdims=True) % q
    return (of_block + of_window + U64(2) * (q - product)) % q


def occurrences(words: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every exact occurrence of the blocks at `starts`, low <= distance < high."""
    found_at, found_by, top = [], [], int(words.max()) + 1
    shifts = high - low
    padded = np.concatenate([words, np.full(high + 2 * size, top, dtype=words.dtype)])
    step = max(1, ROOM // (2 * size))
    for k in range(0, len(starts), step):
        s = starts[k : k + step, None]
        block, window = padded[s + np.arange(size)], padded[s + low + np.arange(shifts + size - 1)]
        zero = squared_differences(block, window, shifts, *PRIMES[0]) == 0
        if size * top * top >= PRIMES[0][0]:
            hit = np.flatnonzero(zero.any(axis=1))
            if len(hit):
                zero[hit] &= squared_differences(block[hit], window[hit], shifts, *PRIMES[1]) == 0
        row, shift = np.nonzero(zero)
        found_at.append(s[row, 0])
        found_by.append(shift + low)
    return np.concatenate(found_at), np.concatenate(found_by)


def _agree(words: np.ndarray, i: int, d: int, step: int) -> int:
    """How many words from i on, by step, are equal to those d after them."""
    n, total, room = len(words) - d, 0, 16
    while True:
        lo, hi = (i, min(i + room, n)) if step > 0 else (max(i - room + 1, 0), i + 1)
        if lo >= hi:
            return total
        differ = words[lo:hi] != words[lo + d : hi + d]
        if differ.any():
            return total + int((differ if step > 0 else differ[::-1]).argmax())
        total += hi - lo
        i, room = i + step * (hi - lo), 2 * room


class _Known:
    """Runs found so far, and which seeds they account for."""

    def __init__(self) -> None:
        self.runs: dict[tuple[int, int], int] = {}
        self.sorted: np.ndarray | None = None

    def add(self, start: int, end: int, period: int) -> None:
        if (start, end) not in self.runs:
            self.runs[start, end] = period
            self.sorted = None

    def accounts_for(self, start: np.ndarray, end: np.ndarray, d: int) -> np.ndarray:
        """Seeds start..end of distance d that lie in a run whose period divides d."""
        if self.sorted is None:
            self.sorted = np.array(sorted((s, e, q) for (s, e), q in self.runs.items()), dtype=np.int64).reshape(-1, 3)
        s, e, _ = self.sorted[d % self.sorted[:, 2] == 0].T
        if not len(s):
            return np.zeros(len(start), dtype=bool)
        # of the runs that start at or before a seed, the one that reaches furthest
        at = np.searchsorted(s, start, side="right") - 1
        return (at >= 0) & (np.maximum.accumulate(e)[np.maximum(at, 0)] >= end)


def runs_of(words: np.ndarray, longest: int, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """All runs of an integer sequence as rows (start, length, period), by start and period.

    longest: no run is longer than this.
    """
    n, known = len(words), _Known()
    if longest < min_words:
        return np.zeros((0, 3), dtype=np.int64)
    order = np.argsort(words, kind="stable")
    recurs = np.full(n, n, dtype=np.int64)
    same = words[order[1:]] == words[order[:-1]]
    recurs[order[:-1][same]] = np.diff(order)[same]
    size, low = 1 << ((min_words // 3).bit_length() - 1), 1
    slowest = np.maximum.reduceat(recurs, np.arange(0, n, size))[: n // size]
    while exponent * low <= longest and len(slowest):
        high = 2 * size
        starts = np.flatnonzero(slowest < high) * size
        if len(starts):
            at, by = occurrences(words, starts, size, low, high)
            order = np.lexsort((at, by))
            at, by = at[order], by[order]
            cuts = np.flatnonzero(np.r_[True, by[1:] != by[:-1], True]) if len(by) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                d, done = int(by[lo]), -1
                seeds = at[lo:hi]
                for s in seeds[~known.accounts_for(seeds, seeds + size + d, d)].tolist():
                    if s < done or not np.array_equal(words[s : s + size], words[s + d : s + d + size]):
                        continue
                    first = s - _agree(words, s - 1, d, -1) if s else s
                    done = s + size + _agree(words, s + size, d, 1)
                    if done + d - first >= max(min_words, exponent * d):
                        known.add(first, done + d, d)
        low, size = high, high
        slowest = slowest[: len(slowest) // 2 * 2].reshape(-1, 2).max(axis=1)
    return np.array(sorted((s, e - s, q) for (s, e), q in known.runs.items()), dtype=np.int64).reshape(-1, 3)


class _Codes(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _collapse(min_words: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, texts, flat, at = _Codes(), [], [], [0]
            for i, text in enumerate(batch.column("text")):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                texts.append(words)
                flat += [np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), np.full(1, -1 - i)]
                at.append(at[-1] + len(words) + 1)
            flat, at = np.concatenate(flat), np.array(at)
            # a number of its own between texts, which no run can hold
            flat[flat < 0] = len(codes) - 1 - flat[flat < 0]
            runs = runs_of(flat, int(np.diff(at).max()) - 1, min_words, exponent)
            bounds = np.searchsorted(runs[:, 0], at)
            collapsed = []
            for words, start, lo, hi in zip(texts, at[:-1].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if lo < hi:
                    keep = np.ones(len(words), dtype=bool)
                    for s, length, q in runs[lo:hi].tolist():
                        keep[s - start + q : s - start + length] = False
                    words = [words[k] for k in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(words))
            runs[:, 0] -= np.repeat(at[:-1], np.diff(bounds))
            items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at) - 1),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (start, length, period), collapsed: one row per document.

    Words are what white space divides. collapsed has one period of each run and all words
    outside runs, joined by one space.
    """
    if exponent < 3 or min_words < 24:
        raise ValueError("runs have an exponent of 3 and 24 words at least")
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_collapse(min_words, exponent), schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts repeat their words from some word on, by a checksum of the doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / F.lit(10)).alias("g"), words.alias("words")).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    rewritten = "array_join(transform(words, (w, i) -> if(i < a, w, words[int(a + (i - a) % p)])), ' ')"
    return rows.select("doc_id", F.expr(f"if(n > 0, {rewritten}, text)").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # cross products compare length / period exactly; the first of equal ones has the smallest start, then period
    best = F.expr(
        "aggregate(runs, cast(null as struct<start: long, length: long, period: long>), "
        "(best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))"
    )
    lines = F.array_join(F.expr("transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n')"), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed").select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}

#: Every pair of equal words of a text would be a row; tests hold the query against a brute-force version instead.
ORACLE: dict[str, str] = {}
