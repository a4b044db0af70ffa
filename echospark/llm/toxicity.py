"""Operator 1: toxicity by weak supervision.

Method. Many voters judge a text: stated lexicons, patterns (shouting, second-person
insults, repeated marks), lexicons that are induced from the labelled rows, and the
annotation itself as one more voter that may err and that abstains on rows without a
label. A generative label model is fitted by expectation maximisation on the counts of
vote patterns. It estimates each voter's accuracy on either class, and the correlation of
voters given the class, by which the votes of voters that speak together are discounted.
The annotation starts the estimates and has a weak prior (`PRIOR_SHARE` of the rows), no
bound. The votes of all documents, labelled or not, are what the model is fitted on. The
posteriors of the labelled rows are the targets of a linear classifier over words and
word beginnings, which scores every whole text.

Held-out rows (crc32 of the id modulo `FOLDS` is 0) never give a label or a vote to anything.

Scale. Labels are taken from at most about `TRAIN_CAP` labelled rows of each label value,
chosen by a hash of the id; a bit set of fixed size picks their texts, so no other text is
shuffled. Feature counts are aggregated in the tasks first. All features that pass a
significance test are kept; their number is bounded by the words of that sample. The votes of
all documents are counted where they are read; what reaches the label model is one count per
vote pattern, of which there are at most 2 to the number of voters. The classifier sees the
kept features (not the texts) of the sample. Scoring is one pass over all documents without a
shuffle.

Edge cases. Null and empty texts have no features and get the score of the intercept, below
0.5 as toxic texts are the rarer kind. Without labels of both kinds only the stated voters
decide. A doc_id with several labels counts once per label. A null doc_id is held out from
learning and marked as not held out. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Workspace, bounded_sample, crc_mod, may_match, slices, table

FOLDS = 5
TRAIN_CAP = 20_000
MIN_POSITIVES = 3
#: Least log odds of a feature that stands for toxic texts; chosen on fold 1 of the learning rows (1 to 5 tried).
MIN_ODDS = 2.0
#: How often the annotation is expected to mark a clean and a toxic text, and what share of the rows this belief weighs.
EXPECTED, PRIOR_SHARE = (0.02, 0.95), 0.05
PREFIXES = (4, 5, 6)
#: Texts that a task works on at a time; each word has several features, so few texts bound the memory of a Python worker.
ROWS = 128
#: Voters made of induced lexicons; each holds the features of one hash class.
INDUCED = 6

#: Insults and slurs in four languages, by lexicon.
LEXICONS = {
    "insults_en": ("idiot", "moron", "stupid", "loser", "clown", "dumb", "fool", "imbecile", "jerk", "freak"),
    "contempt_en": ("worthless", "pathetic", "disgusting", "trash", "scum", "garbage", "filth", "vermin", "shame", "useless"),
    "insults_de": ("trottel", "depp", "dummkopf", "arschloch", "schwachkopf", "blödmann", "abschaum", "versager"),
    "insults_fr": ("connard", "salaud", "imbécile", "crétin", "débile", "ordure", "abruti", "racaille"),
    "insults_es": ("idiota", "imbécil", "estúpido", "basura", "escoria", "cabrón", "payaso", "inútil"),
    "threats": ("kill", "die", "hate", "destroy", "hurt", "töten", "hasse", "tuer", "matar", "odio"),
}
PATTERNS = ("shouting", "exclaims", "insult_near_this")


def _lex(words: tuple[str, ...]) -> np.ndarray:
    return np.sort(np.asarray([K.hash_text(w, K.ALNUM_LOWER)[0] for w in words], dtype=np.uint64))


def _isin(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


_WORD_START_LIMIT = max(PREFIXES)


def features(at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of every word and of its beginnings; words are lower-cased runs of letters and digits."""
    docs, found = [], []
    n_words, hashes = K.word_hashes(at, raw, K.ALNUM_LOWER)
    doc = K.doc_index(n_words)
    docs.append(doc)
    found.append(hashes)
    lower = K.ALNUM_LOWER.values
    k = 0
    for lo, hi in K.blocks(at, raw, K.ALNUM_LOWER.is_word):
        start, end = K.spans(at, raw, K.ALNUM_LOWER, lo, hi)
        d, block = doc[k : k + len(start)], lower[raw[lo:hi]]
        k += len(start)
        run = np.zeros(len(start), dtype=np.uint64)
        for size in range(1, _WORD_START_LIMIT + 1):
            ok = end - start >= size
            d, start, end, run = d[ok], start[ok], end[ok], run[ok]
            run = K.mix(run * np.uint64(31) + block[start + size - 1])
            if size in PREFIXES:
                docs.append(d)
                found.append(run ^ np.uint64(size))
    return np.concatenate(docs), np.concatenate(found)


def _distinct(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, doc))
    doc, feature = doc[order], feature[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    return doc[new], feature[new]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, toxic -> feature, toxic and other texts of this batch with it."""
    for batch in slices(batches, ROWS):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        doc, feature = _distinct(*features(*K.buffers(batch.column("text"))))
        names, back = np.unique(feature, return_inverse=True)
        pos = np.bincount(back, toxic[doc], len(names)).astype(np.int64)
        every = np.bincount(back, minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(pos), pa.array(every - pos)], ["feature", "pos", "neg"])


def telling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of rows(text, toxic) that stand for toxic texts beyond chance: their hashes, sorted, and log odds.

    The likelihood ratio statistic must exceed 2 ln(number of features tested).
    """
    totals = rows.agg(F.count_if(F.col("toxic") > 0).alias("p"), F.count_if(F.col("toxic") <= 0).alias("n")).first()
    if not totals.p or not totals.n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    counts = rows.select("text", "toxic").mapInArrow(_feature_counts, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.filter(f"pos >= {MIN_POSITIVES}")
    p, n = float(totals.p), float(totals.n)
    both = F.col("pos") + F.col("neg")
    term = lambda x, e: F.when(x > 0, 2 * x * F.log(x / e)).otherwise(0.0)
    g = (
        term(F.col("pos"), both * p / (p + n))
        + term(F.col("neg"), both * n / (p + n))
        + term(p - F.col("pos"), (p + n - both) * p / (p + n))
        + term(n - F.col("neg"), (p + n - both) * n / (p + n))
    )
    odds = F.log((F.col("pos") + 0.1) / (p + 0.2)) - F.log((F.col("neg") + 0.1) / (n + 0.2))
    ws = Workspace(rows.sparkSession, "toxicity")
    tested = ws.write(counts.select("feature", g.alias("g"), odds.alias("odds")), "tested")
    limit = 2 * np.log(max(tested.count(), 2))
    best = tested.filter((F.col("odds") > MIN_ODDS) & (F.col("g") > float(limit))).toArrow()
    names = best.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], best.column("odds").to_numpy()[order]


def votes(at: np.ndarray, raw: np.ndarray, induced: np.ndarray) -> np.ndarray:
    """The voters' judgements of each text, 1 or 0: lexicons, patterns, induced lexicons."""
    n = len(at) - 1
    words, hashes = K.word_hashes(at, raw, K.ALNUM_LOWER)
    doc = K.doc_index(words)
    columns, near = [], np.zeros(len(hashes), dtype=bool)
    for name, lexicon in LEXICONS.items():
        hit = _isin(hashes, _lex(lexicon))
        near |= hit & (not name.startswith("threats"))
        columns.append(np.bincount(doc[hit], minlength=n) > 0)
    capitals = np.zeros(n, dtype=np.int64)
    marks = np.zeros(n, dtype=np.int64)
    for lo, hi in K.blocks(at, raw, np.ones(256, dtype=bool)):
        b, owner = raw[lo:hi], np.searchsorted(at, np.arange(lo, hi), side="right") - 1
        capitals += np.bincount(owner[(b >= 65) & (b <= 90)], minlength=n)
        marks += np.bincount(owner[b == 33], minlength=n)
    this = _isin(hashes, _lex(("this", "you", "your", "du", "ihr", "tu", "vous", "eres", "usted", "ese")))
    pointed = np.zeros(len(hashes), dtype=bool)
    for step in (1, 2):
        pointed[step:] |= this[:-step] & (doc[step:] == doc[:-step])
    columns += [capitals > 0.3 * np.maximum(np.diff(at), 1), marks >= 10, np.bincount(doc[near & pointed], minlength=n) > 0]
    d, f = features(at, raw)
    hit = _isin(f, induced)
    d, group = d[hit], (f[hit] % np.uint64(INDUCED)).astype(np.int64)
    table_ = np.zeros((n, INDUCED), dtype=bool)
    table_[d, group] = True
    return np.column_stack([*columns, table_]).astype(np.int8)


class LabelModel:
    """Two-class generative model of votes with class-conditional rates and correlation discounts.

    patterns: distinct vote rows of 1, 0 or -1 (abstains) with their counts; first: the column of
    the annotation, whose votes start the estimates. prior_share: the weight of EXPECTED for that column.
    derived: columns that were made from the annotation; they are discounted for speaking with it, it is not for them.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, first: int, derived: slice = slice(0, 0), rounds: int = 50, prior_share: float = PRIOR_SHARE) -> None:
        self.first, self.derived = first, derived
        x, given, w = np.maximum(patterns, 0).astype(float), (patterns >= 0).astype(float), counts.astype(float)
        said = given[:, first] > 0
        marked = (w * x[:, first]).sum() / max((w * given[:, first]).sum(), 1)
        post = np.where(said, np.where(x[:, first] > 0, 0.9, 0.1), marked)
        extra, weight = np.full((2, x.shape[1]), 0.5), np.ones(x.shape[1])
        weight[first] += prior_share * w.sum()
        extra[:, first] += np.asarray(EXPECTED) * prior_share * w.sum()
        for _ in range(rounds):
            self.prior = float(np.clip((w * post).sum() / max(w.sum(), 1), 1e-4, 0.5))
            self.rate = np.stack([np.clip(((w * p) @ x + e) / ((w * p) @ given + weight), 0.002, 0.998) for p, e in zip((1 - post, post), extra, strict=True)])
            self.weight = self._discounts(x, given, w, post)
            post = self.posterior(patterns)

    def _discounts(self, x: np.ndarray, given: np.ndarray, w: np.ndarray, post: np.ndarray) -> np.ndarray:
        """1 / (1 + the sum of a voter's positive correlations with others, given the class)."""
        total = np.zeros(x.shape[1])
        for c, p in enumerate((1 - post, post)):
            v = w * p
            centred = (x - self.rate[c]) * given
            cov = (centred * v[:, None]).T @ centred / np.maximum((given * v[:, None]).T @ given, 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(corr, 0)
            corr[self.first, self.derived] = 0
            total += v.sum() / max(w.sum(), 1e-9) * np.where(corr > 0.1, corr, 0).sum(axis=1)
        return 1 / (1 + total)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        x, given = np.maximum(patterns, 0).astype(float), (patterns >= 0).astype(float)
        log = [(x * np.log(r) + (given - x) * np.log(1 - r)) @ self.weight for r in self.rate]
        margin = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _fit_linear(indptr: np.ndarray, columns: np.ndarray, target: np.ndarray, size: int, start: np.ndarray, l2: float = 0.01, steps: int = 1000):
    """Logistic regression on soft targets over binary sparse rows, by accelerated gradient steps."""
    rows = np.repeat(np.arange(len(target)), np.diff(indptr))
    w, b = start.copy(), float(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))) - 1.0
    speed_w, speed_b = np.zeros(size), 0.0
    per_row = np.bincount(rows, minlength=len(target)).max() if len(rows) else 1
    rate = 4.0 / (per_row + 1)
    scale = len(target) / np.maximum(np.bincount(columns, minlength=size), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], len(target)) + b, -30, 30)))
        gap = (p - target) / len(target)
        g = (np.bincount(columns, gap[rows], size) + l2 * w / len(target)) * np.minimum(scale, 50)
        speed_w, speed_b = 0.9 * speed_w - rate * g, 0.9 * speed_b - rate * gap.sum()
        w, b = w + speed_w, b + speed_b
    return w, float(b)


class Model:
    """What scoring needs: sorted feature hashes, their weights, the intercept."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.names, self.weights, self.bias = names, weights, bias

    def score(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        doc, feature = features(at, raw)
        hit = _isin(feature, self.names)
        doc, feature = _distinct(doc[hit], feature[hit])
        total = np.bincount(doc, self.weights[np.searchsorted(self.names, feature)], len(at) - 1) if len(doc) else np.zeros(len(at) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def _stated() -> np.ndarray:
    return np.unique(np.concatenate([_lex(v) for v in LEXICONS.values()]))


def _tally(seen: DataFrame, docs: DataFrame, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns and their counts: of the labelled rows seen(votes), and of all other texts of docs, for which the annotation abstains."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            own, n = np.unique(votes(*K.buffers(batch.column("text")), names), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in own], pa.binary()), pa.array(n)], ["votes", "n"])

    found: dict[bytes, int] = {}
    every = docs.select("text").mapInArrow(count, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).toArrow()
    for v, n in zip(every.column("votes").to_pylist(), every.column("n").to_pylist(), strict=True):
        found[v + b"\xff"] = n
    own = seen.groupBy("votes").count().toArrow()
    for v, n in zip(own.column("votes").to_pylist(), own.column("count").to_pylist(), strict=True):
        silent = v[:-1] + b"\xff"
        found[silent] = max(found.get(silent, 0) - n, 0)
        found[v] = found.get(v, 0) + n
    found = {v: n for v, n in sorted(found.items()) if n}
    width = len(LEXICONS) + len(PATTERNS) + INDUCED + 1
    return np.frombuffer(b"".join(found), dtype=np.int8).reshape(-1, width), np.array(list(found.values()))


def train(docs: DataFrame, labels: DataFrame, cap: int = TRAIN_CAP, folds: int = FOLDS) -> Model:
    """A model of labels(doc_id, toxic) over docs(doc_id, text); rows of fold 0 give no labels."""
    ws = Workspace(docs.sparkSession, "toxicity")
    given = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & (crc_mod("doc_id", folds) != 0))
    given = ws.write(bounded_sample(ws, given, "toxic", "doc_id", cap), "given")
    texts = may_match(docs.select("doc_id", "text"), "doc_id", given)
    sample = ws.write(texts.join(given, "doc_id").select("doc_id", "toxic", "text"), "sample")
    names, odds = telling(sample)
    stated = _stated()
    if not len(names):
        return Model(stated, np.full(len(stated), 3.0), -2.0)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            at, raw = K.buffers(batch.column("text"))
            seen = np.column_stack([votes(at, raw, names), np.sign(batch.column("toxic").to_numpy())]).astype(np.int8)
            doc, feature = features(at, raw)
            hit = _isin(feature, names)
            doc, feature = _distinct(doc[hit], feature[hit])
            at_ = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(at_), pa.array(np.searchsorted(names, feature).astype(np.int32)))
            pattern = pa.array([v.tobytes() for v in seen], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pattern, column], ["doc_id", "toxic", "votes", "features"])

    seen = ws.write(sample.mapInArrow(look, "doc_id long, toxic int, votes binary, features array<int>"), "votes")
    patterns, counts = _tally(seen, docs.filter(crc_mod("doc_id", folds) != 0), names)
    width = patterns.shape[1]
    unpack = lambda col: np.frombuffer(b"".join(col.to_pylist()), dtype=np.int8).reshape(-1, width)
    label_model = LabelModel(patterns, counts, first=width - 1, derived=slice(width - 1 - INDUCED, width - 1))
    every = seen.orderBy("doc_id", "votes").select("votes", "features").toArrow()
    target = label_model.posterior(unpack(every.column("votes")))
    lists = every.column("features").combine_chunks()
    at = lists.offsets.to_numpy()
    weights, bias = _fit_linear(at - at[0], lists.flatten().to_numpy(zero_copy_only=False), target, len(names), np.minimum(odds, 4.0) / 2)
    return Model(names, weights, bias)


def score(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            s = model.score(*K.buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_mod("doc_id", folds) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; columns and rows stay as they are, a text is judged where it is read."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            yield batch.filter(pa.array(model.score(*K.buffers(batch.column(names.index("text")))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
