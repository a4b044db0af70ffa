"""Operator 6: quality rules by gradient-boosted trees over document statistics.

Method. Every document gets a row of statistics. Trees are boosted on labelled rows
(logistic loss, histogram splits); a feature may be held monotone, in which case a
split that would break the direction is refused and children keep to the bounds of
their side. The trees are flattened into numpy node arrays (feature, threshold, child,
value), and all documents of a batch walk all trees level by level without branching.

Scale. Statistics, base rules and scores are one pass without a shuffle, in slices of
bounded bytes. Training gathers the statistics (not the texts) of at most about `TRAIN_CAP`
rows per label value, chosen by a hash of their id; a bit set of fixed size picks their
documents, so no other text is shuffled. The driver's work is bounded by that parameter.

Edge cases. A null or blank text has no words, counts of zero, and fails the base
rules. With labels of one kind only, no tree is grown and the base rules decide.
Labels without a document, documents without a label, null labels and repeated rows
are all allowed. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Workspace, bounded_sample, may_match, slices, table

TRAIN_CAP = 20_000
TREES, DEPTH, RATE, BINS, L2 = 60, 4, 0.15, 64, 5.0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words",
    "chars_per_word",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "log_lines",
    "words_per_line",
    "distinct_word_share",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "long_word_share",
    "top_word_share",
    "sentence_share",
    "pipe_share",
    "exclaim_share",
)
#: +1: the score may only rise with the feature, -1: only fall.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1}

_SYMBOL = K._mask([ord(c) for c in "#*$%&|<>"])
_UPPER, _DIGIT = K._mask([*range(65, 91)]), K._mask([*range(48, 58)])
_PUNCT = K._mask([ord(c) for c in "!\"'(),-./:;?"])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which elements of keys occur more than once."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def _mode(hashes: np.ndarray) -> tuple[int, int]:
    """Distinct values and the largest count among them."""
    if not len(hashes):
        return 0, 0
    s = np.sort(hashes)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return len(first), int(np.diff(np.r_[first, len(s)]).max())


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The exact counts of COUNTS and the features of FEATURES for each text of a string column."""
    at, raw = K.buffers(column)
    n_docs = len(at) - 1
    words, hashes = K.word_hashes(at, raw, K.BLANK)
    n_words = np.diff(words)

    def per_doc(mask_of) -> np.ndarray:
        out = np.zeros(n_docs, dtype=np.int64)
        for lo, hi in K.blocks(at, raw, np.ones(256, dtype=bool)):
            total = np.r_[0, np.cumsum(mask_of(raw[lo:hi]))]
            k0, k1 = max(int(np.searchsorted(at, lo, side="right")) - 1, 0), int(np.searchsorted(at, hi, side="left"))
            edge = np.clip(at[k0 : k1 + 1], lo, hi) - lo
            out[k0:k1] += np.diff(total[edge])
        return out

    in_word = K.BLANK.is_word
    out = {"n_words": n_words, "word_chars": per_doc(lambda b: in_word[b] & ((b & 0xC0) != 0x80)), "n_symbols": per_doc(lambda b: _SYMBOL[b])}
    # lines with a word, by the hash of the whole line
    dup, with_word, repeat = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    distinct, top = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    line_at, line_hash, line_words = lines_of(at, raw)
    runs = K.windows(hashes, 3)
    for i in range(n_docs):
        lo, hi = line_at[i], line_at[i + 1]
        h = line_hash[lo:hi][line_words[lo:hi] > 0]
        with_word[i], dup[i] = len(h), len(h) - len(np.unique(h)) if len(h) > 1 else 0
        lo, hi = words[i], words[i + 1]
        distinct[i], top[i] = _mode(hashes[lo:hi])
        if hi - lo > 3:
            twice = _repeated(runs[lo : hi - 2])
            if twice.any():
                hit = np.zeros(hi - lo, dtype=bool)
                for k in range(3):
                    hit[k : k + len(twice)] |= twice
                repeat[i] = hit.sum()
    out |= {"n_dup_lines": dup, "n_repeat_words": repeat}
    chars = np.maximum(out["word_chars"], 1)
    n = np.maximum(n_words, 1)
    share = lambda kind: per_doc(lambda b: kind[b]) / chars
    features = [
        np.log1p(n_words),
        out["word_chars"] / n,
        out["n_symbols"] / n,
        dup / np.maximum(with_word, 1),
        repeat / n,
        np.log1p(with_word),
        n_words / np.maximum(with_word, 1),
        distinct / n,
        share(_UPPER),
        share(_DIGIT),
        share(_PUNCT),
        per_doc(lambda b: in_word[b] & (b >= 0xC0)) / chars,
        top / n,
        per_doc(lambda b: b == 46) / n,
        per_doc(lambda b: b == 124) / n,
        per_doc(lambda b: b == 33) / n,
    ]
    return out | {"features": np.column_stack(features) if n_docs else np.zeros((0, len(FEATURES)))}


def lines_of(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts their non-empty lines: offsets by text, hash of each line, and its number of words."""
    line_at, hashes = K.word_hashes(at, raw, K.LINES)
    starts = [s + lo for lo, hi in K.blocks(at, raw, K.LINES.is_word) for s in [K.spans(at, raw, K.LINES, lo, hi)[0]]]
    words = [s + lo for lo, hi in K.blocks(at, raw, K.BLANK.is_word) for s in [K.spans(at, raw, K.BLANK, lo, hi)[0]]]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    word = np.concatenate(words) if words else np.zeros(0, np.int64)
    # a word belongs to the last line that starts at or before it
    owner = np.searchsorted(start, word, side="right") - 1
    return line_at, hashes, np.bincount(owner, minlength=len(start)).astype(np.int64)


@dataclass
class Trees:
    """Flattened trees: nodes of all trees in one set of arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values, all rows and trees at once, `depth` steps."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: Sequence[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees of a bounded sample. monotone has -1, 0 or 1 for each feature."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    nodes: list[list] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(g, x[:, f], side="left") for f, g in enumerate(grid)])
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
            me = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes.append([0, np.inf, me, me, rate * float(np.clip(total_g / (total_h + L2), lo, hi))])
            if level == depth or len(rows) < 20:
                return me
            best = (1e-3, -1, 0)
            for f, cuts in enumerate(grid):
                if not len(cuts):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(cuts) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                gain = gl**2 / (hl + L2) + gr**2 / (hr + L2) - total_g**2 / (total_h + L2)
                wl, wr = np.clip(gl / (hl + L2), lo, hi), np.clip(gr / (hr + L2), lo, hi)
                gain[(monotone[f] * (wr - wl) < 0) | (hl < 1) | (hr < 1)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            _, f, k = best
            if f < 0:
                return me
            side = binned[rows, f] <= k
            l_rows, r_rows = rows[side], rows[~side]
            mid = 0.5 * (np.clip(g[l_rows].sum() / (h[l_rows].sum() + L2), lo, hi) + np.clip(g[r_rows].sum() / (h[r_rows].sum() + L2), lo, hi))
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[monotone[f]]
            nodes[me][0], nodes[me][1] = f, float(grid[f][k])
            nodes[me][2] = grow(l_rows, g, h, level + 1, *bounds[0])
            nodes[me][3] = grow(r_rows, g, h, level + 1, *bounds[1])
            return me

        for _ in range(trees):
            prob = 1 / (1 + np.exp(-margin))
            root = grow(np.arange(len(y)), y - prob, prob * (1 - prob), 0, -np.inf, np.inf)
            roots.append(root)
            margin = margin + _pack(nodes, [root], 0.0, depth).margin(x)
    return _pack(nodes, roots, base, depth)


def _pack(nodes: list[list], roots: list[int], base: float, depth: int) -> Trees:
    cols = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    kinds = (np.int64, float, np.int64, np.int64, float)
    return Trees(np.asarray(roots, dtype=np.int64), *(np.asarray(c, dtype=k) for c, k in zip(cols, kinds, strict=True)), base, depth)


def train(docs: DataFrame, labels: DataFrame, cap: int = TRAIN_CAP, monotone: dict[str, int] | None = None) -> Trees:
    """Trees for labels(doc_id, quality) over docs(doc_id, text), from at most about `cap` rows of each label value."""
    ws = Workspace(docs.sparkSession, "quality")
    named = ws.write(bounded_sample(ws, labels.select("doc_id", "quality").filter("quality is not null"), "quality", "doc_id", cap), "named")
    sample = may_match(docs.select("doc_id", "text"), "doc_id", named).join(named, "doc_id").select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            f = statistics(batch.column("text"))["features"]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1]), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), flat], ["quality", "features"])

    got = sample.select(F.col("quality").cast("int"), "text").mapInArrow(run, "quality int, features array<double>").toArrow()
    x = got.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    y = (got.column("quality").to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of rows
    sign = {**MONOTONE} if monotone is None else monotone
    return fit(x[order], y[order], [sign.get(f, 0) for f in FEATURES])


def assess(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text) -> counts, base_failed, quality_score and kept of every document."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, quality_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = statistics(batch.column("text"))
            failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
            score = trees.score(s["features"])
            columns = [batch.column("doc_id"), *(pa.array(s[c]) for c in COUNTS), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "base_failed", "kept", "quality_score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assess(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE: dict[str, str] = {}
