"""Operator 10: language identification with string kernels.

Method. A text is the set of its character n-grams (bytes, 1 to `MAX_N` long, letters
lower-cased, other signs as one blank), hashed to `DIMS` places: a blended-spectrum
presence kernel k(x, y) = |x and y| / sqrt(|x| |y|). `LANDMARKS` training texts give the
Nystroem map k(x, landmarks) K^(-1/2), and one-versus-rest kernel ridge regression is
solved in that space. A batch is scored by two matrix products: presence rows times
landmark columns, then the folded weights.

Held-out rows (crc32 of the id modulo `FOLDS` is 2) are never learned from.

Scale. Scoring is one pass without a shuffle, in batches of bounded size whatever the
length of a text. Training takes about `TRAIN_CAP` rows of each language, chosen by a hash
of the id where the texts are read; languages are counted over all rows. The driver gets the
presence rows of the landmarks and, of the other rows, their kernel with the landmarks.

Edge cases. Null texts and texts without a letter are `und` with score 0. Without any
labelled row every text is `und`. Rows that repeat a doc_id are judged row by row. Other
columns are ignored. Ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Workspace, bounded_sample, crc_mod, table

FOLDS, HELD = 4, 2
TRAIN_CAP = 600
LANDMARKS = 128
BITS = 15
DIMS = 1 << BITS
MAX_N = 4
RIDGE = 0.05
ROWS = 128

_CODE = np.full(256, 32, dtype=np.uint64)
_CODE[97:123] = _CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def presence(at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each text the row of the n-grams that it holds, as 0 or 1."""
    n = len(at) - 1
    out = np.zeros((n, DIMS), dtype=np.float32)
    flat = out.reshape(-1)
    for lo in range(0, len(raw), K.BLOCK):
        hi = min(len(raw), lo + K.BLOCK + MAX_N - 1)
        code = _CODE[raw[lo:hi]]
        where = np.arange(lo, hi)
        owner = np.searchsorted(at, where, side="right") - 1
        room = at[owner + 1] - where  # bytes of the text from here on
        base = owner * DIMS
        run = np.zeros(hi - lo, dtype=np.uint64)
        blank = np.ones(hi - lo, dtype=bool)
        for size in range(1, MAX_N + 1):
            m = hi - lo - size + 1
            if m <= 0:
                break
            run = run[:m] * np.uint64(0x100000001B3) + code[size - 1 :] + np.uint64(1)
            blank = blank[:m] & (code[size - 1 :] == 32)
            slot = (run * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
            ok = (room[:m] >= size) & ~blank
            flat[base[:m][ok] + slot[ok].astype(np.int64)] = 1
    return out


def has_letter(column: pa.Array, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_ = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
    out = np.diff(np.r_[0, np.cumsum(ascii_)][at]) > 0
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return out


class Model:
    """Landmark rows, their sizes, and the weights of each language with the Nystroem map folded in."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray) -> None:
        self.langs = langs
        self.columns = np.ascontiguousarray((landmarks / np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[:, None]).T.astype(np.float32))
        self.weights = weights.astype(np.float32)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.columns) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]

    def margins(self, x: np.ndarray) -> np.ndarray:
        k = self.kernel(x)
        return np.column_stack([k, np.ones(len(k), dtype=np.float32)]) @ self.weights


def fit(model: Model, landmarks: np.ndarray, kernel: np.ndarray, langs: np.ndarray) -> Model:
    """One-versus-rest kernel ridge regression of a bounded sample from its kernel with the landmarks."""
    names = model.langs
    values, vectors = np.linalg.eigh(model.kernel(landmarks).astype(float))
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.column_stack([kernel.astype(float) @ root, np.ones(len(kernel))])
    y = np.where(langs[:, None] == np.asarray(names)[None, :], 1.0, -1.0)
    balance = 1 / np.asarray([max((langs == c).sum(), 1) for c in langs])
    gram = (z * balance[:, None]).T @ z
    w = np.linalg.solve(gram + RIDGE * np.diag([*np.ones(z.shape[1] - 1), 1e-6]) * np.trace(gram) / len(gram), (z * balance[:, None]).T @ y)
    model.weights = np.vstack([root @ w[:-1], w[-1:]]).astype(np.float32)
    return model


def train(docs: DataFrame, cap: int = TRAIN_CAP) -> Model:
    """A model of docs(doc_id, text, lang) without the held-out rows."""
    ws = Workspace(docs.sparkSession, "language")
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD))
    sample = ws.write(bounded_sample(ws, known, "lang", "doc_id", cap), "sample")
    names = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not names:
        return Model([], np.zeros((1, DIMS), np.float32), np.zeros((2, 0)))

    def rows_of(batches: Iterator[pa.RecordBatch], of, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = of(presence(*K.buffers(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([r.tobytes() for r in x], kind)], ["doc_id", "lang", "row"])

    def gather(df: DataFrame, of) -> pa.Table:
        run = lambda batches: rows_of(batches, of, pa.binary())
        return df.mapInArrow(run, "doc_id long, lang string, row binary").orderBy("lang", F.xxhash64("doc_id"), "row").toArrow()

    chosen = gather(bounded_sample(ws, sample, "lang", "doc_id", max(LANDMARKS // len(names), 4), "landmarks"), lambda x: np.packbits(x > 0, axis=1))
    if not chosen.num_rows:  # few rows, none of which has a small hash
        chosen = gather(sample, lambda x: np.packbits(x > 0, axis=1)).slice(0, LANDMARKS)
    landmarks = np.unpackbits(np.frombuffer(b"".join(chosen.column("row").to_pylist()), dtype=np.uint8)).reshape(-1, DIMS).astype(np.float32)
    model = Model(names, landmarks, np.zeros((len(landmarks) + 1, len(names))))
    got = gather(sample, model.kernel)
    kernel = np.frombuffer(b"".join(got.column("row").to_pylist()), dtype=np.float32).reshape(got.num_rows, -1)
    return fit(model, landmarks, kernel, np.asarray(got.column("lang").to_pylist(), dtype=object))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score of every document."""
    names = np.asarray([*model.langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            for i in range(0, batch.num_rows, ROWS):
                column = batch.column("text").slice(i, ROWS)
                at, raw = K.buffers(column)
                m = model.margins(presence(at, raw))
                known = has_letter(column, at, raw) & (m.shape[1] > 0)
                best = m.argmax(axis=1) if m.shape[1] else np.zeros(len(m), dtype=np.int64)
                top = np.clip((m.max(axis=1) + 1) / 2, 0, 1) if m.shape[1] else np.zeros(len(m))
                pred += names[np.where(known, best, len(names) - 1)].tolist()
                score.append(np.where(known, top, 0.0).astype(float))
            flat = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(flat)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE: dict[str, str] = {}
