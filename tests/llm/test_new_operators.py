"""Brute-force versions and odd inputs of periodic runs, SimHash groups and vector codes."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from echospark.llm import periodic, simhash, vector_codes
from echospark.llm.common import Workspace

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "a b", "a b c", "A  B\nC", "Ünï cödé 漢字 ✓ \x00 x\x85y \x1c z", "w " * 30_000, "x" * 50_000, "a b c " * 400, "p q " * 12 + "r"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "a b"), (4, "a b"), (None, "a b"), (None, None)]
    rows = [(i, t, "f", 1, "k", "e", 7) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n_words long, component_id string, runs string, label int")


# periodic runs


def all_runs(words, least=24, exponent=3):
    """Every maximal stretch of every period, shortest period first."""
    codes = {}
    w = np.array([codes.setdefault(x, len(codes)) for x in words], dtype=np.int64)
    found = {}
    for q in range(1, len(w) // exponent + 1):
        edges = np.diff(np.r_[0, w[:-q] == w[q:], 0])
        for s, e in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            if e + q - s >= max(least, exponent * q):
                found.setdefault((int(s), int(e + q)), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def rewritten(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected_row(doc_id, text):
    words = rewritten(doc_id, text)
    runs = all_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def none_last(row):
    return tuple((x is None, x) for x in row)


def test_periodic_query_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    expected = sorted(expected_row(r.doc_id, r.text) for r in rows)
    assert sorted(map(tuple, periodic.op11_periodic_runs(spark, SF).collect())) == expected
    assert sum(r[1] for r in expected) > 10


def test_periodic_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic.op11_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = sorted((expected_row(r.doc_id, r.text) for r in odd.collect()), key=none_last)
    assert sorted(map(tuple, out.collect()), key=none_last) == expected
    none = odd.limit(0)
    none.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_planted_periods(seed):
    rng = np.random.default_rng(seed)
    n, kinds = int(rng.integers(0, 900)), int(rng.choice([1, 2, 3, 8, 100, 5000]))
    words = rng.integers(0, kinds, n)
    for _ in range(int(rng.integers(0, 5))):
        if n > 30:
            a = int(rng.integers(0, n))
            length = int(rng.integers(1, n - a + 1))
            i = np.arange(a, a + length)
            words[i] = words[a + (i - a) % int(rng.integers(1, max(2, length // 2)))]
    assert [tuple(r) for r in periodic.runs_of(words, n).tolist()] == all_runs(words.tolist())


@pytest.mark.parametrize("length", [23, 24, 25])
def test_shortest_runs(length):
    words = [f"u{i}" for i in range(9)] + [f"p{i % 8}" for i in range(length)] + [f"v{i}" for i in range(9)]
    w = np.unique(words, return_inverse=True)[1].astype(np.int64)
    assert [tuple(r) for r in periodic.runs_of(w, len(w)).tolist()] == all_runs(words) == ([(9, length, 8)] if length >= 24 else [])


def test_transform_against_direct_sums():
    rng = np.random.default_rng(5)
    for size, shifts in ((8, 15), (16, 16), (64, 64)):
        x, y = rng.integers(0, 1 << 20, (5, size)), rng.integers(0, 1 << 20, (5, shifts + size - 1))
        direct = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(x[r], y[r, j:], strict=False)) for j in range(shifts)] for r in range(5)], dtype=object)
        for p, g in periodic.PRIMES:
            assert (periodic.squared_differences(x, y, shifts, p, g).astype(object) == direct % p).all()


def test_no_text_meets_another(spark):
    """Equal neighbouring rows make no run together."""
    rows = spark.createDataFrame([(i, "a b c d e f g h i j") for i in range(40)], "doc_id long, text string").coalesce(1)
    assert periodic.periodic_runs(rows).filter("size(runs) > 0 or collapsed <> 'a b c d e f g h i j'").count() == 0


# SimHash groups


def simple_fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """The smallest place reachable from each place over links of all pairs."""
    label = np.arange(len(values))
    v = np.array(values, dtype=np.uint64)
    near = [np.flatnonzero(np.bitwise_count(v ^ x) <= 3) for x in v]
    while True:
        new = np.array([label[k].min() for k in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_simhash_query_against_all_pairs(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    own = [simple_fingerprint(t) for _, t in rows]
    expected = [(d, f"{f:016x}", rows[k][0]) for (d, _), f, k in zip(rows, own, groups(own), strict=True)]
    assert sorted(map(tuple, simhash.op12_simhash_near_dedup(spark, SF).collect())) == expected
    assert len({e[2] for e in expected}) < len(expected)


def test_simhash_odd_rows(spark, odd):
    out = simhash.near_duplicates(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint) for r in out) == sorted((r.doc_id is None, r.doc_id, f"{simple_fingerprint(r.text):016x}") for r in odd.collect())
    of = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    zero, ab = "0" * 16, f"{simple_fingerprint('a b'):016x}"
    assert {of[k, zero] for k in (0, 1, 2, None)} == {0} and of[4, ab] == of[None, ab] == 4
    assert of[5, f"{simple_fingerprint('a b c'):016x}"] == of[6, f"{simple_fingerprint('a b c'):016x}"] == 5
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    lone = odd.sparkSession.createDataFrame([(None, "no id")], "doc_id long, text string")
    assert simhash.near_duplicates(lone).collect()[0].component_id is None


@pytest.mark.parametrize("block", [4096, 7])
def test_links_hold_planted_components(spark, monkeypatch, block):
    """Chains, dense clouds and pairs at exactly 3 and 4 bits, over lists of one and of many blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(15):  # a chain of steps of up to 4 bits
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(x)
    cloud = rng.getrandbits(64)
    values |= {cloud ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 5))) for _ in range(120)}
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    found = simhash.links(Workspace(spark, "t"), frame).collect()
    place = {int(np.uint64(v).astype(np.int64)): k for k, v in enumerate(values)}
    label = list(range(len(values)))
    for _ in range(len(values)):
        before = list(label)
        for r in found:
            a, b = place[r.a], place[r.b]
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert label == groups(values)


def test_eight_lists_hold_every_five_positions():
    masks = [{p for p in range(8) if m >> (8 * p) & 0xFF} for m in simhash.MASKS]
    assert len(masks) == 8
    assert all(any(m <= set(five) for m in masks) for five in combinations(range(8), 5))


# vector codes


def exact_codes(vectors):
    """Codes, errors and codebooks of (vec_id, vector) by evaluating every entry, in Python integers."""
    rows = [(i, [math.floor(4096 * x) for x in v]) for i, v in sorted(vectors)]
    d = len(rows[0][1]) // 8
    parts = [[v[p * d : p * d + d] for _, v in rows] for p in range(8)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    books = [list(own[:16]) for own in parts]
    for _ in range(6):
        for p, own in enumerate(parts):
            to = [nearest(x, books[p])[1] for x in own]
            for k in range(len(books[p])):
                mine = [x for x, e in zip(own, to, strict=True) if e == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [[nearest(own[i], books[p]) for p, own in enumerate(parts)] for i in range(len(rows))]
    return {i: ("".join(f"{k:02x}" for _, k in x), sum(e for e, _ in x)) for (i, _), x in zip(rows, last, strict=True)}, books


@pytest.mark.parametrize("n, length", [(1, 8), (5, 16), (60, 24), (300, 64)])
def test_codes_against_all_entries(spark, n, length):
    rng = np.random.default_rng(n)
    vectors = [(i, rng.normal(0, rng.choice([0.01, 0.2, 3]), length).round(3).tolist()) for i in rng.permutation(n).tolist()]
    vectors += [(i + n, vectors[0][1]) for i in range(n // 3)]
    frame = spark.createDataFrame([(i, v, i % 3 or None) for i, v in vectors], "vec_id long, embedding array<double>, label int")
    out, books = vector_codes.compress(frame)
    expected, exact = exact_codes(vectors)
    assert books.tolist() == exact
    assert {r.vec_id: (r.code, r.error) for r in out.collect()} == expected


def test_memo_keeps_every_nearest_entry(monkeypatch):
    rng = np.random.default_rng(2)
    for shift in (0, 4, 9, 14):
        monkeypatch.setattr(vector_codes, "SHIFT", shift)
        book, x = rng.integers(-2000, 2000, (16, 8)), rng.integers(-3000, 3000, (4000, 8))
        x[:2000] = x[0] + rng.integers(-2, 3, (2000, 8))
        book[7] = book[3]
        memo = vector_codes.Memo(book)
        distance = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        for _ in range(2):
            entry, least = memo.assign(x)
            assert (entry == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()


def test_codes_of_odd_rows(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    good = [[x / 8 for x in range(k, k + 8)] for k in range(4)]
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, None] * 4, 1), (4, [nan] * 8, 1), (5, [inf] * 8, 2), (6, [-inf] * 8, 2), (7, [1.0] * 7, 2), (8, [0.5] * 16, None)]
    rows += [(9, good[0], None), (9, good[1], 1), (10, good[2], 1), (10, good[2], 1), (None, good[3], 3)]
    frame = spark.createDataFrame([(*r, "x", 0.5, "c") for r in rows], "vec_id long, embedding array<float>, label int, v string, error double, code string")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = vector_codes.op13_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(map(tuple, out.drop("codebooks_sha256").collect()), key=none_last)
    # the first vector of a fitting length has 16 components; it is the only one of that length
    assert [g[0] for g in got] == [2, 7, 8, 9, 9, 10, 10, None]
    assert [g[1] for g in got if g[1]] == ["00" * 8]
    frame = frame.filter("vec_id is null or vec_id <> 8")
    coded, books = vector_codes.compress(frame)
    got = {(r.vec_id, r.code, r.error) for r in coded.collect() if r.code}
    assert got == {(9, "00" * 8, 0), (9, "01" * 8, 0), (10, "02" * 8, 0), (None, "04" * 8, 0)} and books.shape == (8, 5, 1)
    assert vector_codes.compress(frame.limit(0))[0].count() == 0
    assert vector_codes.compress(frame.filter("vec_id = 7"))[0].collect()[0].code is None
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<double>, label int"))
