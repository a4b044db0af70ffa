"""Operator 3: line deduplication by pairwise alignment.

Method. Every line with a word is hashed, and so is every window: from each line on, and up
to each line, the shortest stretch of at least `MIN_WORDS` words. A window that several
documents hold is owned by the earliest of them (the smallest doc_id). A later document is
paired with the owners of all its windows. Any block of `MIN_WORDS` words that it has in
common with an earlier document is made of such windows, so each line of the block stands
in a window that a partner holds. A pair is aligned with patience diff: lines that are unique on both sides
are matched in their longest common order, matches are extended over equal neighbours, and
the gaps are aligned in the same way. What the aligned blocks leave of the later document is
matched against the whole earlier one again, the longest common run of lines first, so passages
that stand twice or in another order are found too. Common blocks of at least `MIN_WORDS` words
are deleted from the later document. The earliest holder of a line never loses it to a
later one, so no content is lost altogether.

Scale. Windows are shuffled as hashes; the owner of a window is aggregated before the
shuffle. A bit set of fixed size then picks the windows that several documents may hold, and
only those are joined with their owners. A document names at most two owners for each of its
lines, so pairs grow with the lines, not with the square of a window's frequency. Line lists of
pairs (not texts) are joined; a popular window or owner is one row of a written table or scan,
so adaptive execution can split the other side. Texts of documents that may have cuts only
are shuffled.

Edge cases. Null and empty texts have no lines and stay as they are. Blank lines are never
matched; they go with the block that surrounds them. Rows that share a doc_id are one
document's versions: none is later than the other, and each is aligned on its own. Rows
without a doc_id are left alone. Other columns are kept, whatever their names; a report column
whose name is taken gets an underscore.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import BITS, Workspace, bit_set, by_bit_set, fresh, in_bit_set, may_match, slices, slot_of, table
from .quality import lines_of

MIN_WORDS = 50
_BLANK = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: An odd number and its inverse modulo 2**64.
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, version, hashes and word counts of the lines with a word, in order."""
    for batch in slices(batches):
        at, raw = K.buffers(batch.column("text"))
        offsets, hashes, words = lines_of(at, raw)
        keep = words > 0
        kept = np.r_[0, np.cumsum(keep)][offsets].astype(np.int32)
        signed = hashes[keep].view(np.int64)
        version = [int(np.add.reduce(K.mix(hashes[keep][a:b] * np.arange(1, 2 * (b - a) + 1, 2, dtype=np.uint64))).astype(np.int64)) if b > a else 0 for a, b in zip(kept[:-1], kept[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(version, pa.int64()),
                pa.ListArray.from_arrays(pa.array(kept), pa.array(signed)),
                pa.ListArray.from_arrays(pa.array(kept), pa.array(words[keep].astype(np.int32))),
            ],
            ["doc_id", "version", "lines", "words"],
        )


def _unique_matches(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines that occur once in either range, as the longest run of pairs that ascends in both."""
    count_a, count_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    place = {x: i for i, x in enumerate(a[alo:ahi], alo) if count_a[x] == 1}
    pairs = [(place[x], j) for j, x in enumerate(b[blo:bhi], blo) if count_b[x] == 1 and x in place]
    tails, ends, back = [], [], [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        t = bisect_left(tails, i)
        if t == len(tails):
            tails.append(i)
            ends.append(k)
        else:
            tails[t], ends[t] = i, k
        back[k] = ends[t - 1] if t else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: ascending pairs (i, j) with a[i] == b[j]."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        matches = _unique_matches(a, b, alo, ahi, blo, bhi)
        if matches:
            edges = [(alo - 1, blo - 1), *matches, (ahi, bhi)]
            out += matches
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _match_lengths(a: list, b: list) -> list[int]:
    """For each line of b, the length of the longest run of lines up to it that stands anywhere in a (suffix automaton of a)."""
    step, link, size, last = [{}], [-1], [0], 0
    for x in a:
        new, p = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if size[q] != size[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q], q = copy, copy
            link[new] = q
        last = new
    out, state, n = [], 0, 0
    for x in b:
        while state and x not in step[state]:
            state = link[state]
            n = size[state]
        state, n = (step[state][x], n + 1) if x in step[state] else (0, 0)
        out.append(n)
    return out


def _blocks_left(a: list, b: list, total: np.ndarray, gaps: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Ranges of b inside the gaps that stand anywhere in a, the longest of a gap first, until no block of min_words is left."""
    held = set(a)
    # only a stretch of min_words in lines that a has can hold a block
    todo = []
    for lo, hi in gaps:
        start = lo
        for j in range(lo, hi + 1):
            if j == hi or b[j] not in held:
                if total[j] - total[start] >= min_words:
                    todo.append((start, j))
                start = j + 1
    if not todo:
        return []
    wanted = {x for lo, hi in todo for x in b[lo:hi]}
    source = [x if x in wanted else None for x in a]
    source = [x for x, before in zip(source, [None, *source], strict=False) if x is not None or before is not None]
    length, out = np.array(_match_lengths(source, b)), []
    while todo:
        lo, hi = todo.pop()
        if total[hi] - total[lo] < min_words:
            continue
        ends = np.arange(lo + 1, hi + 1)
        starts = np.maximum(ends - length[lo:hi], lo)
        words = total[ends] - total[starts]
        k = int(np.argmax(words))
        if words[k] >= min_words:
            p, q = int(starts[k]), int(ends[k])
            out.append((p, q))
            todo += [(lo, p), (q, hi)]
    return out


def common_blocks(a: list, b: list, words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Ranges of b that stand in a as well, line by line, with at least min_words words.

    Blocks of the alignment come first. What they leave of b (a passage that b has twice, or in
    another order than a) is matched against the whole of a until no block is left.
    """
    runs: list[list[int]] = []
    last = (-2, -2)
    for i, j in aligned(a, b):
        if (i, j) == (last[0] + 1, last[1] + 1):
            runs[-1][1] = j + 1
        else:
            runs.append([j, j + 1])
        last = (i, j)
    total = np.r_[0, np.cumsum(words, dtype=np.int64)]
    blocks = [(lo, hi) for lo, hi in runs if total[hi] - total[lo] >= min_words]
    edges = [0, *(x for block in blocks for x in block), len(b)]
    gaps = list(zip(edges[::2], edges[1::2], strict=True))
    return sorted(blocks + _blocks_left(a, b, total, gaps, min_words))


def _deleted(min_words: int):
    """doc_id, version, lines, words, owner_lines -> ranges (lo, hi) of lines to delete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, lo, hi = [], [], []
            for i in range(batch.num_rows):
                a, b = batch.column("owner_lines")[i].as_py(), batch.column("lines")[i].as_py()
                for p, q in common_blocks(a, b, batch.column("words")[i].as_py(), min_words):
                    take.append(i)
                    lo.append(p)
                    hi.append(q)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("version").take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                ["doc_id", "version", "lo", "hi"],
            )

    return run


def _slot(window: str):
    return F.shiftrightunsigned(window, 64 - BITS).cast("int")


def _windows(min_words: int, shared=None):
    """doc_id, version, lines, words -> doc_id, version, window: a hash of every shortest stretch of at least min_words words.

    shared: a broadcast bit set of the windows that are wanted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column("lines").offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            lines = batch.column("lines").flatten().to_numpy().view(np.uint64)
            total = np.r_[0, np.cumsum(batch.column("words").flatten().to_numpy(), dtype=np.int64)]
            n, row = len(lines), np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            # the shortest stretch from each line on, and the shortest up to each line, inside the document
            hi = np.searchsorted(total, total[:-1] + min_words)
            lo = np.searchsorted(total, total[1:] - min_words, side="right") - 1
            on, back = np.flatnonzero(hi <= offsets[1:][row]), np.flatnonzero(lo >= offsets[:-1][row])
            a, b, row = np.r_[on, lo[back]], np.r_[hi[on], back + 1], np.r_[row[on], row[back]]
            # a polynomial of the lines that does not depend on where the stretch stands
            power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
            sums = np.r_[np.uint64(0), np.cumsum(lines * np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)])[:n])]
            window = K.mix((sums[b] - sums[a]) * power[a] + (b - a).astype(np.uint64)).view(np.int64)
            if shared is not None:
                own = in_bit_set(shared.value, (window.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64))
                row, window = row[own], window[own]
            order = np.lexsort((window, row))
            row, window = row[order], window[order]
            first = np.r_[True, (row[1:] != row[:-1]) | (window[1:] != window[:-1])][: len(row)]
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("version").take(at), pa.array(window[first])], ["doc_id", "version", "window"]
            )

    return run


def partners(ws: Workspace, rows: DataFrame, min_words: int) -> DataFrame:
    """Pairs (doc_id, version, owner) to align, from rows(doc_id, version, lines, words)."""
    schema = "doc_id long, version long, window long"
    each = rows.mapInArrow(_windows(min_words), schema)
    owners = each.groupBy("window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("last > owner").drop("last")
    owners = ws.write(owners, "owners")
    shared = rows.sparkSession.sparkContext.broadcast(bit_set(owners.select(_slot("window").alias("slot"))))
    each = rows.mapInArrow(_windows(min_words, shared), schema)
    pairs = ws.write(each.join(owners, "window").filter("doc_id > owner").select("doc_id", "version", "owner").distinct(), "pairs")
    ws.drop(owners)
    return pairs


def deletions(ws: Workspace, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version, ranges: the line ranges to delete, for the documents that have any."""
    rows = docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(_lines, "doc_id long, version long, lines array<long>, words array<int>")
    rows = ws.write(rows.filter(F.size("lines") > 0), "lines")
    pairs = partners(ws, rows, min_words)
    sources = may_match(rows, "doc_id", pairs.select("owner")).select(F.col("doc_id").alias("owner"), F.col("lines").alias("owner_lines"))
    later = may_match(rows, "doc_id", pairs.select("doc_id")).dropDuplicates(["doc_id", "version"])
    lined = pairs.join(later, ["doc_id", "version"]).join(sources, "owner").select("doc_id", "version", "lines", "words", "owner_lines")
    cut = lined.mapInArrow(_deleted(min_words), "doc_id long, version long, lo int, hi int")
    cut = ws.write(cut.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("ranges")), "deletions")
    ws.drop(rows, pairs)
    return cut


def _cut_text(text: str, ranges: list[dict]) -> tuple[str, int, int]:
    """The text without the given ranges of its lines with a word, the number of lines and words deleted."""
    lines = text.split("\n")
    at = [i for i, line in enumerate(lines) if line.strip(_BLANK)]
    drop: set[int] = set()
    named: set[int] = set()
    for r in ranges:
        drop.update(range(at[r["lo"]], at[r["hi"] - 1] + 1))
        named.update(at[r["lo"] : r["hi"]])
    words = sum(len(_WORD.findall(lines[i])) for i in named)
    return "\n".join(x for i, x in enumerate(lines) if i not in drop), len(named), words


def _with_cuts(docs: DataFrame, min_words: int, n_lines: str, n_words: str) -> DataFrame:
    """docs with the deleted blocks cut out of `text`, and what was deleted in two more columns of these names."""
    ws = Workspace(docs.sparkSession, "lines")
    gone = deletions(ws, docs, min_words)
    doc, cuts = fresh("__doc", docs), fresh("__cuts", docs)
    by_doc = ws.write(gone.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("version", "ranges")).alias(cuts)), "cuts")
    ws.drop(gone)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given, texts = batch.column(len(names)), batch.column(place)
            out, lines_gone, words_gone = texts.to_pylist(), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            hit = np.flatnonzero(given.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                some = pa.RecordBatch.from_arrays([pa.array(hit), texts.take(pa.array(hit))], ["doc_id", "text"])
                versions = [v for lines in _lines(iter([some])) for v in lines.column("version").to_pylist()]
                for i, version in zip(hit.tolist(), versions, strict=True):
                    ranges = [r for c in given[i].as_py() if c["version"] == version for r in c["ranges"]]
                    if ranges:
                        out[i], lines_gone[i], words_gone[i] = _cut_text(out[i], ranges)
            columns = batch.columns[:-1]
            columns[place] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_gone), pa.array(words_gone)], [*names, n_lines, n_words])

    schema = T.StructType([*docs.schema.fields]).add(n_lines, "long").add(n_words, "long")
    may, same = by_bit_set(docs, "doc_id", bit_set(by_doc.select(slot_of(doc).alias("slot"))))
    cut = may.join(by_doc, F.col("doc_id") == F.col(doc), "left").select(*names, cuts).mapInArrow(run, schema)
    return cut.union(same.withColumns({n_lines: F.lit(0).cast("long"), n_words: F.lit(0).cast("long")}))


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """docs with the deleted blocks cut out of `text`; all columns and rows stay. report adds lines_deleted and words_deleted."""
    out = _with_cuts(docs, min_words, fresh("lines_deleted", docs), fresh("words_deleted", docs))
    return out if report else out.select(*docs.columns)


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """deduplicate_lines, without the documents that lost all their words; n_chars follows the text."""
    lines, words = fresh("__lines", docs), fresh("__words", docs)
    cut, changed = _with_cuts(docs, min_words, lines, words), F.col(lines) > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.filter(~changed | F.rlike("text", F.lit(_WORD.pattern))).select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return docs.select("doc_id", "lines_deleted", "words_deleted", F.octet_length("text").cast("long").alias("bytes_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE: dict[str, str] = {}


def text_digest(text: str) -> str:
    """The digest of op3 for a text."""
    return hashlib.sha256(text.encode()).hexdigest()
