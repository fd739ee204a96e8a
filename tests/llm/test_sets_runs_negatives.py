"""Operators 11 to 13 against plain Python, over the awkward cases: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlake.llm import hard_negatives, minhash, queries, word_runs

from tests.llm.test_operators import odd, rows_of, table, words  # noqa: F401


def edited(text, places, seed):
    parts = text.split()
    for p in places:
        parts[p] = f"edit{seed}x{p}"
    return " ".join(parts)


def crowd():
    """Texts that are alike to several degrees: copies, edits above and below the limit, chains, a passage that most have, and many half-alike ones."""
    base, passage = " ".join(words(300, 7, 5000)), " ".join(words(120, 8, 5000))
    rows = [(100 + i, edited(base, range(10, 10 + i), i)) for i in range(40)]  # i words at one place: from far above to below the limit
    rows += [(200 + i, edited(base, [20 * k for k in range(i)], i)) for i in range(12)]
    rows += [(300 + i, " ".join(words(110, 300 + i, 5000)) + " " + passage) for i in range(60)]  # half alike: none linked
    rows += [(400 + i, base.upper() + "  \n") for i in range(30)]
    rows += [(500 + i, " ".join(words(400 + 20 * i, 77, 5000))) for i in range(12)]  # a chain of prefixes
    return rows + [(600, "a b"), (601, "A\tb"), (602, "a b c"), (603, "x " * 900), (604, "x " * 50_000)]


def test_minhash(spark, odd):
    rows = [r for r in odd if r[0] is not None] + crowd()
    got = minhash.group_documents(table(spark, rows))
    assert sorted(set(rows_of(got))) == minhash.brute_force(rows) and got.count() == len(rows)
    nulls = minhash.group_documents(table(spark, [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (4, "q r s t u v"), (None, "only here and not elsewhere")]))
    assert sorted(map(repr, rows_of(nulls))) == sorted(map(repr, [(None, 2, 3, False), (None, 0, None, True), (3, 2, 3, True), (4, 2, 4, True), (None, 1, None, True)]))
    assert minhash.group_documents(table(spark, [])).count() == 0


def test_union_sketches_never_lose_links(spark):
    """The estimate and the prefix of rare hashes hold for pairs of any sizes at the limit of similarity."""
    rng, rows = np.random.default_rng(5), []
    for k in range(300):
        union = int(rng.integers(1, 400))
        both = math.ceil(union * 17 / 20)
        hashes = np.unique(rng.integers(-(1 << 62), 1 << 62, union + 8))[:union]
        rng.shuffle(hashes)
        cut = both + int(rng.integers(0, union - both + 1))
        a, b = sorted(hashes[:cut].tolist()), sorted([*hashes[:both].tolist(), *hashes[cut:].tolist()])
        rows.append((k, a[: minhash.K], b[: minhash.K], len(a), len(b)))
    pairs = spark.createDataFrame(rows, "k long, a array<long>, b array<long>, na long, nb long")
    common = F.size(F.array_intersect("a", "b"))
    wrong = pairs.where(~minhash.passes("a", "b") | (common < minhash.needed(F.col("na"))) | (common < minhash.needed(F.col("nb"))))
    assert wrong.count() == 0


def test_hot_lists_make_few_pairs(spark):
    docs = table(spark, crowd())
    points = minhash.sketches(docs).where("n > 0").dropDuplicates(["fp"]).withColumn("row", F.xxhash64("fp")).cache()
    pairs, shared = minhash.overlaps(minhash.inverted_lists(points))
    assert 0 < pairs.count() <= 4 * points.count() and shared.count() <= points.count() * minhash.K


piece = st.lists(st.integers(0, 3), min_size=1, max_size=30)
texts = st.lists(st.tuples(piece, st.integers(1, 9)), min_size=0, max_size=6).map(lambda ps: [b"%d" % x for p, k in ps for x in p * k])


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_runs_equal_brute_force(documents):
    for words_, found in zip(documents, word_runs.runs_of_documents(documents), strict=True):
        assert [tuple(r) for r in found.tolist() if r[1] >= 24] == word_runs.brute_force(words_)


def test_runs_survive_hash_collisions(monkeypatch):
    """With a hash of few values extensions go too far; the comparison word by word sets them right."""
    rnd = random.Random(4)
    documents = [[b"%d" % rnd.randrange(3) for _ in range(40)] * 4 + [b"%d" % rnd.randrange(3) for _ in range(100)] for _ in range(10)]
    plain = word_runs._Extension.__init__
    monkeypatch.setattr(word_runs._Extension, "__init__", lambda self, hashes: plain(self, hashes & np.uint64(0)))
    for words_, found in zip(documents, word_runs.runs_of_documents(documents), strict=True):
        assert [tuple(r) for r in found.tolist() if r[1] >= 24] == word_runs.brute_force(words_)


def run_row(doc_id, text):
    """The contract of op12, plainly."""
    words_ = word_runs.repeat_tail(doc_id, (text or "").encode().split())
    runs = word_runs.brute_force(words_)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words_) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_word_runs(spark, odd):
    rows = odd + [(700 + i, " ".join(words(90 + i, i, 6))) for i in range(60)]
    rows += [(800, "a b " * 11 + "a"), (801, "a b " * 12), (802, "x " * 24), (803, "x " * 23), (804, ("p q r s t u v w " * 3) + "end"), (805, "Ab ab " * 20)]
    got = word_runs.digest(word_runs.find_runs(table(spark, rows), rewrite=word_runs.repeat_tail))
    assert rows_of(got) == sorted((run_row(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in rows_of(got)) > 6
    long = table(spark, [(1, "u v w " * 100_000), (2, " ".join(words(300_000, 9, 50_000)) + " k l" * 50_000)])
    found = {r.doc_id: r for r in word_runs.find_runs(long).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, 300_000, 3)] and found[1].collapsed == "u v w"
    assert [tuple(r) for r in found[2].runs][-1] == (300_000, 100_000, 2) and found[2].n_words == 400_000
    assert word_runs.digest(word_runs.find_runs(table(spark, []))).count() == 0


def test_repeat_tail_repeats(spark):
    changed = 0
    for i in range(400):
        w = [b"%d" % k for k in range(50 + i)]
        h = word_runs.zlib.crc32(str(i).encode())
        a, p = (h // 10) % len(w), 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8)
        want = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))] if h % 10 == 0 else w
        changed += want != w
        assert word_runs.repeat_tail(i, w) == want
    assert changed > 10


VECTORS = "vec_id long, embedding array<double>, label int"


def vectors(n=900, d=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=d) + i % 3).round(2).tolist(), i % 4) for i in range(n)]
    rows += [(5000 + i, rows[100][1], 1 + i % 2) for i in range(40)]  # ties
    bad = [None, [], [None] * d, [math.nan] * d, [math.inf] + [0.0] * (d - 1), [1.0]]
    return rows + [(6000 + 100 * i, v, 1) for i, v in enumerate(bad)] + [(7000, rows[0][1], None)]


@pytest.mark.parametrize("blocks", [(131_072, 8192), (100, 3)])
def test_hard_negatives(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"anchor_id": F.lit("x"), "rank": F.lit(None).cast("int"), "v": F.lit(0), "numbers": F.lit(1)})
    again = df.unionByName(df.limit(50)).unionByName(spark.createDataFrame([(None, rows[0][1], 1)], VECTORS), allowMissingColumns=True)
    taken = hard_negatives.numbered(hard_negatives.corrupted(again))
    got = hard_negatives.mine(taken, F.col("vec_id") % 100 == 0, row_block=blocks[0], anchor_block=blocks[1])
    assert rows_of(got) == sorted(hard_negatives.brute_force(rows), key=repr) and got.count() > 100
    assert hard_negatives.mine(hard_negatives.numbered(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_packed_products_are_exact(data):
    d = data.draw(st.integers(0, 7))
    most = data.draw(st.sampled_from([3, 300, 1 << 20, 1 << 40, (1 << 63) - 1]))
    numbers = st.lists(st.integers(-most, most), min_size=d, max_size=d)
    candidates = data.draw(st.lists(numbers, min_size=1, max_size=20)) * data.draw(st.sampled_from([1, 60]))
    anchor = data.draw(numbers)
    packs = hard_negatives.Packs(np.array(candidates, np.int64).reshape(len(candidates), d), np.array([anchor], np.int64).reshape(1, d))
    got = np.concatenate([packs.scores(anchor, p) for p in range(len(packs.packs))])
    assert [int(x) for x in got] == [sum(a * b for a, b in zip(anchor, c, strict=True)) for c in candidates]


def test_new_queries_are_registered():
    assert {"op11_minhash", "op12_word_runs", "op13_hard_negatives"} <= set(queries.QUERIES)
