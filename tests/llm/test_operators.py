"""Brute-force versions, round trips, held-out accuracy and odd inputs of the training-data operators."""

import glob
import hashlib
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echospark.llm import decontamination, language, licenses, line_dedup, near_dedup, packing, quality, queries, toxicity, url_filter, warc
from echospark.llm import textkernel as K
from echospark.llm.common import Workspace, components

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text, pattern=BLANK):
    return pattern.findall((text or "").translate(ASCII))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


ODD = [None, "", " \n\t ", "one", "a b c d", "a b c d", "A  B\nC d", "Ünï cödé 漢字 ✓ \x00 x\x85y", "w " * 60_000, "x" * 50_000, "l1 l1\nl1 l1\n\nl1 l1", "<|endoftext|> tail"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows and ids, null ids, and columns whose names clash with results."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(4, "a b c d"), (4, "other text"), (None, "a b c d"), (None, None)]
    rows = [(i, t, None, "s", 1, 2.0, "k", True, 3) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, component_id string, kept boolean, row int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- kernel


@pytest.mark.parametrize("pattern,kind", [(BLANK, K.BLANK_LOWER), (ALNUM, K.ALNUM_LOWER)])
def test_words_match_regular_expressions(pattern, kind):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB9 .,é漢\n\t\x0b-_~\x85") for _ in range(rng.randrange(60))) for _ in range(300)] + [None, ""]
    at, hashes = K.word_hashes(*K.buffers(pa.array(texts)), kind)
    seen = {}
    for i, t in enumerate(texts):
        want = words_of(t, pattern)
        got = hashes[at[i] : at[i + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_small_blocks_give_the_same_hashes(monkeypatch):
    texts = ["alpha beta " * 50, "", "x" * 500, "gamma delta"]
    one = K.word_hashes(*K.buffers(pa.array(texts)), K.BLANK)
    monkeypatch.setattr(K.blocks, "__defaults__", (37,))
    two = K.word_hashes(*K.buffers(pa.array(texts)), K.BLANK)
    assert one[0].tolist() == two[0].tolist() and one[1].tolist() == two[1].tolist()


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, x) for x in range(201, 230)]
    ws = Workspace(spark, "test")
    got = {r.node: r.label for r in components(ws, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 230)} == {200}


# ---------------------------------------------------------------- whole queries against SQL


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    def ordered(df):
        df = df[sorted(df.columns)]
        return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)

    got, want = ordered(queries.queries()[name](spark, SF).toPandas()), ordered(duck.sql(queries.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


# ---------------------------------------------------------------- near duplicates


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_near_duplicates_of_edited_copies(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice((6, 12, 40, 150, 400)))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            if rng.random() < 0.3:
                copy = copy[: rng.randrange(len(copy) // 2, len(copy)) + 1]
            rows.append((n, " ".join(copy)))
            n += 1
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "OUTER", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 3000)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, 80)


def test_estimate_is_close():
    rng = np.random.default_rng(7)
    for share in (0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[: int(3000 * share)], rng.integers(0, 2**63, 3000 - int(3000 * share)).astype(np.uint64)])
        x, y = near_dedup.registers(np.unique(a))[None], near_dedup.registers(np.unique(b))[None]
        j, _ = near_dedup.estimate(x, y, np.array([3000]), np.array([3000]))
        assert abs(j[0] - share / (2 - share)) < 0.2


def near_clash(spark, rows):
    return spark.createDataFrame([(i, t, 1, True, 2) for i, t in rows], "doc_id long, text string, __kept int, __stays boolean, __slot int")


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(2, text), (9, text), (9, other), (4, other + " x"), (4, other + " x"), (5, None), (5, None), (6, ""), (None, text), (7, "alone here"), (7, "not the same")]
    got = near_dedup.drop_near_duplicates(near_clash(spark, rows))
    assert got.columns == ["doc_id", "text", "__kept", "__stays", "__slot"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, text), (4, other + " x"), (5, None), (5, None), (6, ""), (7, "alone here"), (7, "not the same")], key=str)


def test_prints_never_hide_a_pair():
    rng = np.random.default_rng(12)
    for share in (0.5, 0.7, 0.8, 0.9, 1.0):
        a = np.unique(rng.integers(0, 2**63, 150).astype(np.uint64))
        b = np.unique(np.r_[a[: int(len(a) * share)], rng.integers(0, 2**63, len(a) - int(len(a) * share)).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        prints = pa.array([x.astype(np.uint16).tobytes() for x in (a, b, b[:0])], pa.binary())
        ok = near_dedup._room(prints[0], prints[1:], len(a), np.array([len(b), 300]), 80)
        assert ok[1] and (ok[0] or 100 * common < 80 * (len(a) + len(b) - common))
        assert share >= 0.8 or not ok[0]


# ---------------------------------------------------------------- decontamination


def test_contamination_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((0, 1, 5, 13, 20))))) for i in range(25)] + [(3, None), (None, "t1 t2 t3"), (7, "t4 t4 t4")]
    rows = []
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            body[5:5] = words_of(rng.choice(items)[1], ALNUM)
        rows.append((i, " ".join(body)))
    rows += [(100, None), (101, ""), (5, rows[5][1])]
    want = []
    for d, t in rows:
        w, hit, found = words_of(t, ALNUM), set(), set()
        for item, text in items:
            q = words_of(text, ALNUM)
            n = min(13, len(q))
            for s in range(len(q) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit.update(range(p, p + n))
                        if item is not None:
                            found.add(item)
        want.append((d, len(w), len(hit), len(found), decontamination.items_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_contaminated_rows_go_one_by_one(spark):
    item = " ".join(f"t{i}" for i in range(15))
    rows = [(1, item, 0, 0), (1, "a clean row of the same id", 0, 0), (None, item, 0, 0), (None, "clean", 0, 0), (2, None, 0, 0), (3, "", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc int, __hits int")
    got = decontamination.drop_contaminated(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, rows[1][1]), (None, "clean"), (2, None), (3, "")], key=str)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b x x c a b c"), (2, "a x x x x b c")], "doc_id long, text string")
    got = {(r.doc_id, r.start) for r in decontamination.proximity_matches(docs, spark.createDataFrame([(0, "c B a")], "item_id long, text string"), 4).collect()}
    want = set()
    for d, t in ((1, "a x b x x c a b c"), (2, "a x x x x b c")):
        w = t.split()
        want |= {(d, i) for i in range(len(w)) if w[i] in "abc" and {"a", "b", "c"} <= set(w[i : i + 4])}
    assert got == want


# ---------------------------------------------------------------- packing


def test_packing_round_trip(spark, docs, odd):
    vocabulary, ranks = packing.default_vocabulary()
    slow = packing._encoders(vocabulary, ranks)[0]
    for df in (docs.limit(60), odd):
        rows = df.select("doc_id", "text").collect()
        got = packing.pack(df, vocabulary, ranks).collect()
        assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in got)
        back, now = [], None
        for r in got:
            if r.start == 0:
                now = []
                back.append((r.doc_id, now, r.doc_tokens))
            assert r.start == len(now) and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, dtype="<u4").tobytes())
            now += r.ids
        assert all(len(ids) == n for _, ids, n in back)
        want = Counter((r.doc_id, tuple([*slow.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in rows)
        assert Counter((d, tuple(ids)) for d, ids, _ in back) == want


def test_buckets_hold_one_length(spark, odd, tmp_path):
    packing.write_buckets(packing.pack(odd, *packing.default_vocabulary()), f"file://{tmp_path}/b")
    back = spark.read.parquet(f"file://{tmp_path}/b").collect()
    assert back and all(len(r.ids) == r.length for r in back)


# ---------------------------------------------------------------- quality


def brute_statistics(text):
    words = BLANK.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {p for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_counts(spark, docs, odd):
    trees = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    for df in (docs, odd):
        want = Counter((r.doc_id, *brute_statistics(r.text)) for r in df.select("doc_id", "text").collect())
        got = quality.assess(df, trees).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)


def test_quality_verdict_held_out_and_by_walking_trees(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels.filter("crc32(cast(doc_id as string)) % 5 <> 0"))
    got = quality.assess(docs, trees).join(labels.filter("crc32(cast(doc_id as string)) % 5 = 0 and quality is not null"), "doc_id").filter("not base_failed").toPandas()
    assert len(got) > 300 and ((got.quality > 0) == got.kept).mean() > 0.97

    def walk(row):
        total = trees.base
        for node in trees.roots.tolist():
            for _ in range(trees.depth):
                node = int(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node])
            total += trees.value[node]
        return total

    x = quality.statistics(pa.array([r.text for r in docs.limit(40).collect()]))["features"]
    assert np.allclose(trees.margin(x), [walk(r) for r in x])


def test_quality_of_odd_labels(spark, docs, odd):
    for rows in ([(1, 1, 0), (10**6, 0, 0), (2, None, 0)], [(i, 1, 0) for i in range(30)], [(None, 1, 0), (None, 0, 0)]):
        got = quality.assess(odd, quality.train(docs, labels_of(spark, rows))).collect()
        assert len(got) == odd.count() and all(0 <= r.quality_score <= 1 for r in got)


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(9)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.15 * rng.standard_normal(3000) > 0.5).astype(float)
    trees = quality.fit(x, y, [1, -1, 0])
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.8
    probe = np.repeat(rng.random((50, 3)), 20, axis=0)
    for f, sign in ((0, 1), (1, -1)):
        p = probe.copy()
        p[:, f] = np.tile(np.linspace(0, 1, 20), 50)
        steps = np.diff(trees.margin(p).reshape(50, 20), axis=1) * sign
        assert steps.min() > -1e-9


# ---------------------------------------------------------------- toxicity and language


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    hit = got.predicted == got.toxic
    assert hit.mean() > 0.95 and (got[got.toxic == 0].predicted == 0).mean() > 0.98 and (got[got.toxic == 1].predicted == 1).mean() > 0.8


def test_label_model_recovers_the_rates_of_voters():
    rng = np.random.default_rng(14)
    n, prior = 40_000, 0.15
    truth = rng.random(n) < prior
    rates = np.array([[0.02, 0.6], [0.05, 0.5], [0.01, 0.3], [0.1, 0.7], [0.03, 0.85]])
    votes = (rng.random((n, 5)) < rates[:, truth.astype(int)].T).astype(np.int8)
    copied = np.where(rng.random(n) < 0.95, votes[:, 0], 1 - votes[:, 0]).astype(np.int8)  # speaks with the first voter
    votes = np.column_stack([votes[:, :4], copied, np.where(rng.random(n) < 0.3, -1, votes[:, 4])])  # the annotation abstains on 30 %
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.LabelModel(patterns, counts, first=5)
    want = np.vstack([rates[:4], [0.05 + 0.9 * 0.02, 0.05 + 0.9 * 0.6], rates[4]]).T
    assert np.abs(model.rate - want).max() < 0.05 and abs(model.prior - prior) < 0.02
    assert model.weight[0] < 0.8 and model.weight[4] < 0.8 and model.weight[1:4].min() > 0.8
    # posteriors against Bayes' rule with the true rates of the independent voters
    post = model.posterior(votes)
    assert ((post > 0.5) == truth).mean() > 0.95


def test_votes_of_all_documents_reach_the_label_model(spark, monkeypatch):
    """Every learning row is counted once, in its pattern; the annotation abstains on rows without a label."""
    rows = [(i, "you idiot" if i % 7 == 0 else "a calm text about rivers and hills " * 3) for i in range(2000)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    given = labels_of(spark, [(i, 0, int(i % 7 == 0)) for i in range(0, 2000, 4)])
    seen = {}

    class Spy(toxicity.LabelModel):
        def __init__(self, patterns, counts, **more):
            seen.update(patterns=patterns, counts=counts)
            super().__init__(patterns, counts, **more)

    monkeypatch.setattr(toxicity, "LabelModel", Spy)
    toxicity.train(docs_, given)
    learning = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    said = seen["patterns"][:, -1]
    by_vote = {v: int(seen["counts"][said == v].sum()) for v in (-1, 0, 1)}
    assert by_vote == {-1: sum(i % 4 > 0 for i in learning), 0: sum(i % 4 == 0 and i % 7 > 0 for i in learning), 1: sum(i % 28 == 0 for i in learning)}


def test_toxicity_without_labels_uses_the_stated_words(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot"), (2, "a kind word"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.train(docs, labels_of(spark))).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0}


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_kernel_against_sets(spark):
    rng = random.Random(15)
    texts = ["".join(rng.choice("abcdeé .,1") for _ in range(rng.randrange(1, 90))) for _ in range(12)]

    def grams(text):
        raw = [c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode()]
        return {tuple(raw[i : i + k]) for k in range(1, language.MAX_N + 1) for i in range(len(raw) - k + 1) if any(c != 32 for c in raw[i : i + k])}

    x = language.presence(*K.buffers(pa.array(texts)))
    k = language.Model([], x, np.zeros((13, 0))).kernel(x)
    sets = [grams(t) for t in texts]
    want = np.array([[len(a & b) / max(np.sqrt(len(a) * len(b)), 1) for b in sets] for a in sets])
    assert np.abs(k - want).max() < 0.02


def test_language_of_texts_without_letters(spark, docs):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "the and"), (5, "漢字")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.train(docs)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] != "und" and got[5] != "und"


# ---------------------------------------------------------------- urls


def test_url_ties_go_to_the_smaller_text(spark):
    """Equally long rules that fit one URL, in place and by a join; a listed rule beats a longer pattern."""
    rules = tuple(url_filter.prefix_rule(v, n) for v, n in (("block", "com/x/"), ("allow", "a.com/"), ("block", "b.com/"), ("allow", "com/b/")))
    rules += (url_filter.Rule("pattern-com-long-name", "block", "com", ("com",)),)
    urls = ["http://a.com/x/", "http://b.com/b/", "http://c.com/", "http://b.com/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for inline in (512, 0):
        got = {r.page_id: (r.rule, r.verdict, r.matched) for r in url_filter.judge(pages, rules, inline=inline).collect()}
        assert got == {0: ("a.com/", "allow", "a.com/"), 1: ("b.com/", "block", "b.com/"), 2: (None, "block", "pattern-com-long-name"), 3: ("b.com/", "block", "b.com/")}


def test_url_rules_both_ways(spark):
    urls = [None, "", "nothing", "http://Example.COM/en/x?q", "https://a.example.com/en/", "https://www.example.com/en/1", "http://x.net/es/2", "http://net/fr/", "http://evilexample.com/en/", "ftp://spam-farm.org/", "http://a.com", "http://m.free-bets.example.org/de/#top", "http://a.b.com?x/en/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(None, urls[3], 1)], "page_id long, url string, rule int")
    one, two = (sorted(map(str, url_filter.judge(pages, inline=n).collect())) for n in (512, 0))
    assert one == two
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect() if r.page_id is not None}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/x", "example.com/en/", "block") and got[5][2:] == ("www.example.com/en/", "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7][2:] == ("net/fr/", "block") and got[8][2:] == ("com/", "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[11][2:] == (None, "block")
    assert got[12][:3] == ("a.b.com", "", None)


# ---------------------------------------------------------------- warc


def test_warc_round_trip(spark, tmp_path):
    big, other = "päge " * 40, "x\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (3, "http://b/", big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", other), (None, "u", big), (None, "u", "z" * 200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload_bytes string")
    warc.write(pages, f"file://{tmp_path}/w", max_records=3)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, f"file://{tmp_path}/w").collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and h == big and i != 3
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 3 if again else None)] += 1
    assert got == want


def test_warc_of_an_empty_table_and_a_long_page(spark, tmp_path):
    schema = "page_id long, url string, html string"
    warc.write(spark.createDataFrame([], schema), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0
    long = "ab\r\n\r\ncd " * 400_000
    warc.write(spark.createDataFrame([(2, "u", long), (1, "u", long), (3, "u", long[:-1])], schema), f"file://{tmp_path}/long")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, f"file://{tmp_path}/long").collect()}
    assert got == {1: ("response", None, len(long)), 2: ("revisit", 1, len(long)), 3: ("response", None, len(long) - 1)}


# ---------------------------------------------------------------- licences


def test_license_spellings(spark):
    texts = ["licensed UNDER the mit licence", "Copyright (c) 2020 X\nReleased under the MIT License!", "pre\n  Licensed under CC-BY-NC 4.0 \npost", "MIT", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(df, licenses.registry(spark), True).collect()}
    assert got == {0: ("MIT", "MIT"), 1: ("MIT", "MIT"), 2: (None, "CC-BY-NC-4.0"), 3: (None, ""), 4: (None, ""), 5: (None, "")}
    plan = licenses.scan(df, licenses.registry(spark), True)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_whole_licences_and_wrapped_notices(spark):
    known = dict(licenses.KNOWN[::-1])
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n, break_on_hyphens=False) for p in t.split("\n\n"))
    texts = [f"Copyright (c) {y} Some Author. All rights reserved.\n\n" + wrap(t, n) for y, n in ((1999, 60), (2024, 79)) for _, t in licenses.KNOWN if "\n\n" in t]
    names = [a for _ in range(2) for a, t in licenses.KNOWN if "\n\n" in t]
    notice = known["MPL-2.0"]
    texts += ["Some file.\n\n" + wrap(notice, 50) + "\n\nMore text.", "(c) 2020 X. Released under the MIT License.", "licence licence", "Copyright 2020 X\nLicenced under the MIT licence, all rights reserved", "(c) You must retain all notices"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(df, licenses.registry(spark), True).collect()}
    n = len(names)
    assert [got[i][0] for i in range(n)] == names
    assert [got[n + i] for i in range(5)] == [(None, "MPL-2.0"), ("MIT", "MIT"), (None, ""), ("MIT", "MIT"), (None, "")]
    more = spark.createDataFrame([("X-1", "License license"), ("X-2", "(C) you must retain all NOTICES!")], "license string, text string")
    got = {r.doc_id: r.whole_license for r in licenses.scan(df, licenses.registry(spark, more), False).collect()}
    assert got[n + 2] == "X-1" and got[n + 4] == "X-2"


# ---------------------------------------------------------------- lines


def test_alignment_is_ordered_and_equal():
    rng = random.Random(10)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = line_dedup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
    assert line_dedup.aligned([1, 2, 3, 4], [9, 2, 3, 8]) == [(1, 1), (2, 2)]


def test_repeated_passages_stay_once(spark):
    line = lambda s: " ".join(f"{s}{i}" for i in range(30))
    passage = [line("p"), line("q")]
    texts = {
        1: [line("a"), *passage, line("b")],
        2: [line("c"), passage[0], "", passage[1], line("d")],
        3: passage,
        4: [line("e"), passage[0], line("f")],
        5: [line("a"), line("g")],
        6: ["short line", *passage, "short line"],
    }
    rows = [(i, "\n".join(x), "en", "s", 5) for i, x in texts.items()] + [(7, None, None, None, None), (None, "\n".join(passage), "en", "s", 1), (2, "\n".join(texts[2]), "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = line_dedup.deduplicate_lines(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == ["\n".join(texts[1])] and by[3] == [""] and by[4] == ["\n".join(texts[4])] and by[5] == ["\n".join(texts[5])]
    assert by[2] == ["\n".join([line("c"), line("d")])] * 2 and by[6] == ["short line\nshort line"] and by[7] == [None] and by[None] == ["\n".join(passage)]
    kept = line_dedup.drop_repeated(df)
    assert 3 not in {r.doc_id for r in kept.collect()} and kept.columns == df.columns


def passage(name, lines=6, words=10):
    return [" ".join(f"{name}{i}w{j}" for j in range(words)) for i in range(lines)]


def line_cuts(spark, texts):
    df = spark.createDataFrame(list(enumerate("\n".join(t) for t in texts)), "doc_id long, text string")
    return {r.doc_id: r.text.split("\n") if r.text else [] for r in line_dedup.deduplicate_lines(df).collect()}


def test_every_owner_of_a_run_is_a_partner(spark):
    p, q, heading = passage("p"), passage("q"), ["a heading"]
    # two passages of different documents, one after the other
    got = line_cuts(spark, [p + ["x"], q + ["y"], ["own"] + p + q])
    assert got[0] == [*p, "x"] and got[1] == [*q, "y"] and got[2] == ["own"]
    # a passage of many documents after a heading that two documents share
    got = line_cuts(spark, [p + [f"z{i}"] for i in range(8)] + [heading + ["h"], heading + p])
    assert got[0] == [*p, "z0"] and got[8] == [*heading, "h"] and got[9] == heading
    # every line of the passage has an earlier owner of its own
    got = line_cuts(spark, [[x] for x in p] + [["k", *p], [*p, "m"]])
    assert got[6] == ["k", *p] and got[7] == ["m"]
    # blocks that overlap in a line and have different owners; the last line is short
    tail = ["five more words of text"]
    got = line_cuts(spark, [p + ["x"], p[3:] + q[:3] + ["y"], q[:3] + q[3:] + tail, ["own", *p, *q, *tail]])
    assert got[3] == ["own"]


def test_passages_twice_or_in_another_order(spark):
    p, q, r = passage("p"), passage("q"), passage("r", 8)
    got = line_cuts(spark, [p + ["x"], ["u", *p, "v", *p, "w"]])
    assert got[0] == [*p, "x"] and got[1] == ["u", "v", "w"]
    got = line_cuts(spark, [p + ["x"] + q + ["y"] + r, ["u", *r, "v", *q, "w", *p]])
    assert got[1] == ["u", "v", "w"]
    # the passage stands twice on both sides
    got = line_cuts(spark, [[*p, "x", *p], ["u", *p, "v", *p, "w", *p]])
    assert got[1] == ["u", "v", "w"]


def test_no_common_block_is_left():
    rng = random.Random(11)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        words, least = [1 + x for x in b], rng.choice([4, 8, 12])
        blocks = line_dedup.common_blocks(a, b, words, least)
        runs = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        assert all(tuple(b[p:q]) in runs and sum(words[p:q]) >= least for p, q in blocks)
        assert all(q <= r for (_, q), (r, _) in zip(blocks, blocks[1:], strict=False))
        edges = [0, *(x for block in blocks for x in block), len(b)]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            assert not any(tuple(b[i:j]) in runs and sum(words[i:j]) >= least for i in range(lo, hi) for j in range(i + 1, hi + 1))


def brute_cut_lines(texts, least):
    """Lines of each document in a common run of `least` words with any earlier one, all pairs of documents."""
    out = []
    for j, b in enumerate(texts):
        gone = set()
        for a in texts[:j]:
            runs = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
            for x in range(len(a)):
                for y in range(len(b)):
                    if a[x] == b[y]:
                        runs[x + 1, y + 1] = runs[x, y] + 1
                        lo = y + 1 - runs[x + 1, y + 1]
                        if sum(len(t.split()) for t in b[lo : y + 1]) >= least:
                            gone.update(range(lo, y + 1))
        out.append([t for i, t in enumerate(b) if i not in gone])
    return out


def test_quilts_of_passages_against_all_pairs(spark):
    rng = random.Random(13)
    pieces = [passage(f"s{i}_", rng.choice((2, 3, 6)), rng.choice((10, 25))) for i in range(14)]
    texts = []
    for d in range(120):
        quilt = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice(pieces)
            lo = rng.randrange(len(piece)) if rng.random() < 0.3 else 0
            quilt += piece[lo:] + ([f"own line {d} {len(quilt)}"] if rng.random() < 0.6 else [])
        texts.append(quilt)
    got = line_cuts(spark, texts)
    assert [got[i] for i in range(len(texts))] == brute_cut_lines(texts, line_dedup.MIN_WORDS)


def test_columns_named_like_the_report(spark):
    df = spark.createDataFrame([(1, "\n".join(passage("p")), 7, "k"), (2, "\n".join(passage("p")), 8, "k")], "doc_id long, text string, lines_deleted int, __cuts string")
    out = line_dedup.deduplicate_lines(df, report=True)
    assert out.columns == [*df.columns, "lines_deleted_", "words_deleted"]
    assert [(r.doc_id, r.lines_deleted, r.lines_deleted_) for r in line_dedup.deduplicate_lines(df, report=True).orderBy("doc_id").collect()] == [(1, 7, 0), (2, 8, 6)]
    assert [r.doc_id for r in line_dedup.drop_repeated(df).collect()] == [1]


def test_no_line_is_lost(spark, docs):
    out = line_dedup.deduplicate_lines(docs)
    lines = lambda df: {x for r in df.collect() for x in r.text.split("\n") if BLANK.search(x)}
    assert lines(out) == lines(docs)


# ---------------------------------------------------------------- odd and empty inputs


def test_odd_inputs_do_not_crash(spark, odd, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n = odd.count()
    bench = spark.createDataFrame([(1, "a b c d"), (1, None), (None, "x"), (2, "")], "item_id long, text string")
    assert toxicity.score(odd, toxicity.train(docs, labels)).count() == n
    assert decontamination.contamination(odd, bench).count() == n
    assert near_dedup.near_duplicates(odd).count() == n
    assert licenses.scan(odd, licenses.registry(spark), True).count() == n
    assert language.identify(odd, language.train(docs)).count() == n
    assert line_dedup.deduplicate_lines(odd).count() == n
    assert near_dedup.drop_near_duplicates(odd).columns == odd.columns and decontamination.drop_contaminated(odd, bench).columns == odd.columns
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_empty_tables(spark, none):
    labels = labels_of(spark)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    assert decontamination.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert packing.pack(none, *packing.default_vocabulary()).count() == 0
    assert quality.assess(none, quality.train(none, labels)).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert licenses.scan(none, licenses.registry(spark), True).count() == 0
    assert language.identify(none, language.train(none)).count() == 0
    assert line_dedup.deduplicate_lines(none, report=True).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    """Each stage on its own input: rows that it must drop are gone, clean rows stay, columns stay."""
    ws, docs = Workspace(spark, "test"), spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = ws.write(stage(spark, docs, SF), name)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "near_dedup":
            comp = {d: c for d, _, c in brute_components(list(before.items()), 5, 80)}
            assert set(after) == {d for d, c in comp.items() if d == c}
        if name == "decontamination":
            windows = {tuple(w[i : i + min(13, len(w))]) for _, t in bench for w in [words_of(t, ALNUM)] for i in range(max(len(w) - 12, 1 if w else 0))}
            for d, t in before.items():
                w = words_of(t, ALNUM)
                hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
                assert (d in after) == (not hit or 20 * len(hit) < len(w))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {len(r.ids) == r.length and r.length & (r.length - 1) == 0 for r in packed.collect()} == {True}
    assert {f.rpartition("/")[0].rpartition("/")[2] for f in packed.inputFiles()} == {f"length={n}" for n in {r.length for r in packed.collect()}}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (4, ""), (5, " \n"), (6, "short")]
    labels_of(spark).write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for k, given in enumerate((rows, [])):
        docs = spark.createDataFrame([(*r, None, "s", 1) for r in given], schema)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{k}{name}")
            docs = spark.read.parquet(f"file://{tmp_path}/{k}{name}")
        packed = docs.collect()
        want = [1, 3, 4, 4, 5, 6, None] if given else []
        assert sorted((r.doc_id for r in packed if r.start == 0), key=str) == want


def test_near_dedup_compares_sets_of_like_sizes_only(spark, monkeypatch):
    n = spark.range(1, 20001).select(F.col("id").alias("n"), F.ceil(F.col("id") * 0.8).alias("m"))
    step = near_dedup.size_class(F.col("n"), 80) - near_dedup.size_class(F.col("m"), 80)
    assert n.filter(~step.between(0, 1)).count() == 0
    rows, write = {}, near_dedup.Workspace.write

    def spy(ws, df, name):
        out = write(ws, df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup.Workspace, "write", spy)
    sig = near_dedup.registers(np.unique(np.random.default_rng(4).integers(0, 2**63, 3000).astype(np.uint64))).view(np.int64).tolist()
    # classes 4 and 5 are like sizes apart from the first one, the others are too far from any
    sizes = [1000, 30, 100, 300, 5000, 4100, 20000]
    classes = spark.createDataFrame([(i, m, sig, b"") for i, m in enumerate(sizes)], "cid long, n long, sig array<long>, prints binary")
    shared = spark.createDataFrame([(0, sig[0], i, 0) for i in range(len(sizes))], "k1 int, k2 long, cid long, a long")
    none = spark.createDataFrame([], "node long, label long")
    near = near_dedup._near(near_dedup.Workspace(spark, "near"), shared, none, classes, 80)
    assert len(near.collect()) == 1 and {near.collect()[0].a, near.collect()[0].label} == {4, 5}
    assert rows["members"] == [2]
