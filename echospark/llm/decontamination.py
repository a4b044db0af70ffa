"""Operator 4: benchmark decontamination with a distributed positional inverted index.

Method. Benchmark items give windows of `size` words (shorter items: one window).
Pass 1 counts the corpus frequency of every benchmark term. Each window then names its
three rarest terms with their offsets. Pass 2 stores the positional postings of those
terms only: one row (term, document, positions). Lists of a window are shifted by their
offset and intersected, the rarest first, which leaves candidate starts. Pass 3 confirms
each candidate on the document's whole token stream, so exact phrases are exact.
`proximity_matches` uses the same index for terms within a given span.

Scale. The only things sent to all tasks are bit sets of fixed size (2 MB) that say
which terms, and which documents, may be of interest; false members cost a few rows and
change nothing. Texts are shuffled for documents with candidates only.
Postings, candidates and hits are shuffled by term and document; a term in a third of
all documents is one row per document, and joins on it are plain equi-joins that
adaptive execution splits. The benchmark may be of any size.

Edge cases. Null or empty texts have no words and are clean. Items without words have
no windows. An item whose item_id is null marks words but is not counted or listed.
Repeated documents and items are allowed; a repeated doc_id is judged row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import BITS, Workspace, bit_set, by_bit_set, fresh, in_bit_set, slices, slot_of, table

WINDOW = 13
ANCHORS = 3


def _windows(size: int):
    """item_id, text -> one row per window: its hash, length, and term hashes by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hashes = K.word_hashes(*K.buffers(batch.column("text")), K.ALNUM_LOWER)
            ids, item, length, terms = batch.column("item_id").to_pylist(), [], [], []
            window = []
            for i in range(len(words) - 1):
                h = hashes[words[i] : words[i + 1]]
                n = min(size, len(h))
                for s in range(len(h) - n + 1 if n else 0):
                    item.append(ids[i])
                    length.append(n)
                    terms.append(h[s : s + n].view(np.int64).tolist())
                    window.append(int(np.uint64(K.window_hash(h[s : s + n])).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(window, pa.int64()), pa.array(length, pa.int32()), pa.array(terms, pa.list_(pa.int64()))],
                ["item_id", "window", "length", "terms"],
            )

    return run


def _bitmap(terms: DataFrame) -> np.ndarray:
    """The bit set of terms(term), by the top bits of the hash."""
    return bit_set(terms.select(F.shiftrightunsigned("term", 64 - BITS).cast("int").alias("slot")))


def _members(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return in_bit_set(bitmap, (hashes >> np.uint64(64 - BITS)).astype(np.int64))


def _counts(shared):
    """text -> term, n: this task's number of occurrences of the terms of interest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in slices(batches, 2048):
            _, hashes = K.word_hashes(*K.buffers(batch.column("text")), K.ALNUM_LOWER)
            terms, n = np.unique(hashes[_members(bitmap, hashes)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])

    return run


def _postings(shared):
    """doc_id, text -> term, doc_id, positions of the terms of interest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in slices(batches):
            words, hashes = K.word_hashes(*K.buffers(batch.column("text")), K.ALNUM_LOWER)
            at = np.flatnonzero(_members(bitmap, hashes))
            doc = np.searchsorted(words, at, side="right") - 1
            position = (at - words[doc]).astype(np.int32)
            order = np.lexsort((position, hashes[at], doc))
            doc, term, position = doc[order], hashes[at][order], position[order]
            new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]) if len(doc) else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(doc)].astype(np.int32)), pa.array(position))
            yield pa.RecordBatch.from_arrays(
                [pa.array(term[new].view(np.int64)), batch.column("doc_id").take(pa.array(doc[new])), lists], ["term", "doc_id", "positions"]
            )

    return run


def index(ws: Workspace, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional inverted index of docs(doc_id, text) for terms(term): term, doc_id, positions."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))
    rows = docs.select("doc_id", "text").mapInArrow(_postings(shared), "term long, doc_id long, positions array<int>")
    return ws.write(rows.join(terms.select("term").distinct(), "term", "left_semi"), "postings")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Occurrences in docs of terms(term)."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms))
    counted = docs.select("text").mapInArrow(_counts(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return terms.select("term").distinct().join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def candidates(ws: Workspace, docs: DataFrame, windows: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """windows(window, length, terms) -> window, length, doc_id, starts where the rarest terms all stand at their offsets."""
    places = windows.select("window", "length", F.posexplode("terms").alias("at", "term"))
    counts = term_counts(docs, places)
    ranked = (
        places.join(counts, "term")
        .groupBy("window", "length")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "at", "term"))), 1, anchors).alias("rarest"))
    )
    ranked = ws.write(ranked, "anchors")
    posted = index(ws, docs, ranked.select(F.explode("rarest.term").alias("term")))
    nth = lambda i: ranked.filter(F.size("rarest") > i).select("window", "length", F.col("rarest")[i].alias("r"))
    shifted = lambda i: (
        nth(i)
        .select("window", "length", F.col("r.term").alias("term"), F.col("r.at").alias("at"))
        .join(posted, "term")
        .select("window", "length", "doc_id", F.expr("transform(positions, p -> p - at)").alias("starts"))
    )
    found = shifted(0)
    for i in range(1, anchors):
        other = shifted(i).select("window", "length", F.col("doc_id").alias("__doc"), F.col("starts").alias("more"))
        has = [found.window == other.window, found.length == other.length, found.doc_id.eqNullSafe(other["__doc"])]
        both = found.join(other, has).select(found.window, found.length, "doc_id", F.array_intersect("starts", "more").alias("starts"))
        short = found.filter(F.col("length") <= i)
        found = both.filter(F.size("starts") > 0).union(short)
    return found.select("window", "length", "doc_id", F.filter("starts", lambda s: s >= 0).alias("starts")).filter(F.size("starts") > 0)


def _counted(shared):
    """slot, doc_id, text -> doc_id, n_words, and the text where the document may have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in slices(batches):
            words, _ = K.word_hashes(*K.buffers(batch.column("text")), K.ALNUM_LOWER)
            may = in_bit_set(bits, batch.column("slot").to_numpy().astype(np.int64))
            text = batch.column("text").take(pa.array(np.arange(batch.num_rows), mask=~may))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words)), text], ["doc_id", "n_words", "text"])

    return run


_JUDGED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("window", T.LongType()), T.StructField("length", T.IntegerType())]))),
    ]
)


def _confirmed(own: np.ndarray, hits: list[dict]) -> tuple[int, list[dict]]:
    """Of the word hashes of a text and its candidates: how many words are hit, and the windows that do occur."""
    edge, seen, runs = np.zeros(len(own) + 1, dtype=np.int64), set(), {}
    for hit in hits:
        n = hit["length"]
        if n not in runs:
            runs[n] = K.windows(own, n).view(np.int64)
        at = np.asarray(hit["starts"], dtype=np.int64)
        at = at[at < len(runs[n])]
        at = at[runs[n][at] == hit["window"]]
        if len(at):
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            seen.add((hit["window"], n))
    return int((np.cumsum(edge)[:-1] > 0).sum()), [{"window": w, "length": n} for w, n in sorted(seen)]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, doc_id, n_words, text, hits[(window, length, starts)] -> confirmed hit words and windows."""
    found_type = pa.list_(pa.struct([("window", pa.int64()), ("length", pa.int32())]))
    for batch in slices(batches):
        words, hashes = K.word_hashes(*K.buffers(batch.column("text")), K.ALNUM_LOWER)
        hits = batch.column("hits")
        told = [_confirmed(hashes[words[i] : words[i + 1]], hits[i].as_py()) if hits[i].is_valid else (0, []) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("n_words"), pa.array([n for n, _ in told], pa.int64()), pa.array([f for _, f in told], found_type)],
            ["row", "doc_id", "n_words", "n_hit", "found"],
        )


def _candidates_by_doc(ws: Workspace, docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(__doc, hits of each document that may have any; window, length, item_id, terms of all windows)."""
    owners = ws.write(
        benchmark.select("item_id", "text").mapInArrow(_windows(size), "item_id long, window long, length int, terms array<long>"), "windows"
    )
    distinct = owners.groupBy("window", "length").agg(F.first("terms").alias("terms"))
    hits = candidates(ws, docs, distinct)
    hits = hits.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("window", "length", "starts")).alias("hits"))
    return ws.write(hits, "hits"), owners


def exact_matches(ws: Workspace, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(judged documents, window owners): row, doc_id, n_words, n_hit, found windows; and window, length, item_id."""
    docs = docs.select("doc_id", "text")
    hits, owners = _candidates_by_doc(ws, docs, benchmark, size)
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(hits.select(slot_of("__doc").alias("slot"))))
    counted = docs.select(slot_of("doc_id").alias("slot"), "doc_id", "text").mapInArrow(_counted(shared), "doc_id long, n_words long, text string")
    judged = (
        counted.join(hits, counted.doc_id.eqNullSafe(F.col("__doc")), "left")
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "text", "hits")
        .mapInArrow(_judge, _JUDGED)
    )
    judged = ws.write(judged, "judged")
    ws.drop(hits)
    return judged, owners.select("window", "length", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = 5) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> per document its words, hit words, items and verdict.

    contaminated: at least one hit word, and hit words are `percent` of all words or more.
    """
    ws = Workspace(docs.sparkSession, "decontamination")
    judged, owners = exact_matches(ws, docs, benchmark, size)
    items = (
        judged.select("row", F.explode("found").alias("w"))
        .select("row", F.col("w.window").alias("window"), F.col("w.length").alias("length"))
        .join(owners.filter("item_id is not null"), ["window", "length"])
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    none = F.array().cast("array<string>")
    out = judged.drop("found").join(items, "row", "left").withColumn("items", F.coalesce("items", none))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """phrases(item_id, text) -> item_id, doc_id, start: all words of the phrase within `span` consecutive words, in any order.

    Starts are the first positions of such spans that begin with a word of the phrase.
    Repeated words of a phrase count once; a phrase without words matches nothing.
    """
    ws = Workspace(docs.sparkSession, "proximity")
    terms = ws.write(
        phrases.select("item_id", "text")
        .mapInArrow(_windows(1), "item_id long, window long, length int, terms array<long>")
        .select("item_id", F.col("terms")[0].alias("term"))
        .distinct(),
        "terms",
    )
    need = terms.groupBy("item_id").agg(F.count("*").alias("need"))
    places = terms.join(index(ws, docs, terms), "term").select("item_id", "term", "doc_id", F.explode("positions").alias("pos"))
    # a start reaches every later place in its span; both sides meet in blocks of span words
    block = lambda c: F.expr(f"cast(floor({c} / {span}) as int)")
    left = places.select("item_id", "doc_id", F.col("pos").alias("start")).withColumn("block", F.explode(F.array(block("start"), block("start") + 1)))
    right = places.withColumn("block", block("pos"))
    near = left.join(right, (left.item_id == right.item_id) & left.doc_id.eqNullSafe(right.doc_id) & (left.block == right.block))
    near = near.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + span))
    hits = near.groupBy(left.item_id.alias("item_id"), left.doc_id.alias("doc_id"), "start").agg(F.countDistinct("term").alias("have"))
    return hits.join(need, "item_id").filter("have = need").select("item_id", "doc_id", "start")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, percent: int = 5) -> DataFrame:
    """docs without the rows that the benchmark contaminates; columns stay as they are, each row is judged by its own text.

    Rows whose id has no candidate pass where they are read; the others are joined with theirs.
    """
    ws, names = Workspace(docs.sparkSession, "decontamination"), docs.columns
    hits, _ = _candidates_by_doc(ws, docs.select("doc_id", "text"), benchmark, size)
    may, others = by_bit_set(docs, "doc_id", bit_set(hits.select(slot_of("__doc").alias("slot"))))
    doc, found = fresh("__doc", docs), fresh("__hits", docs)
    hits = hits.select(F.col("__doc").alias(doc), F.col("hits").alias(found))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, hashes = K.word_hashes(*K.buffers(batch.column(names.index("text"))), K.ALNUM_LOWER)
            given, keep = batch.column(len(names)), np.ones(batch.num_rows, dtype=bool)
            for i in np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False)).tolist():
                n_hit, _ = _confirmed(hashes[words[i] : words[i + 1]], given[i].as_py())
                keep[i] = not (n_hit and 100 * n_hit >= percent * (words[i + 1] - words[i]))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(keep))

    judged = may.join(hits, F.col("doc_id").eqNullSafe(F.col(doc)), "left").select(*names, found).mapInArrow(clean, docs.schema)
    return others.union(judged)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op4_benchmark_decontamination": rf"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(ws) - 11, 2))) AS t(i) WHERE len(ws) > 0),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
lens AS (SELECT DISTINCT n FROM win),
g AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM d, lens, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
m AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM g JOIN win ON g.g = win.g AND g.n = win.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS t(p) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
}


def items_digest(items: list[int]) -> str:
    """The digest of op4 for a list of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
