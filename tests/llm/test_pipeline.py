import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import decontaminate, line_dedup, near_copies, quality, queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus of the documents' columns, in a folder like the driver's."""
    root = str(tmp_path_factory.mktemp("sf"))
    good = lambda i: " ".join(f"w{(i * 7919 + k * 31) % 997}{'.' if k % 9 == 8 else ''}" for k in range(120))
    shared = "\nThis passage of many words is the same in several documents of the corpus."
    rows = [(i, good(i) + (shared if i % 5 == 0 else ""), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, good(i) + (shared if i % 5 == 0 else ""), "en", "s") for i in range(5)]  # exact copies
    rows += [(200 + i, "spam " * 90, None, None) for i in range(25)] + [(300, None, None, None), (301, "", "en", "s")]
    rows += [(400, good(7)[:200] + " " + " ".join(f"b{k}" for k in range(40)), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for name in ("score", "predicted", "kept", "lost", "hits", "fp", "stats", "label"):  # names that the operators use
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in [*range(0, 60), *range(200, 225)]], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(30))), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, corpus)
        rows = out.collect()
        if name != "tokens":
            assert out.columns == columns
        ids = {r.doc_id for r in rows}
        if name == "quality":
            model = quality.fit_documents(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
            good = {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
            assert ids == good and not ids & set(range(200, 225)) and set(range(60)) <= ids
        if name == "lines":
            want = {w[0]: w for w in line_dedup.brute_force([(r.doc_id, r.text) for r in before])}
            assert {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows} == {k: w[3] for k, w in want.items()}
            assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)
        if name == "near_duplicates":
            assert ids == near_copies.brute_force([(r.doc_id, r.text) for r in before])  # five words and a similarity of 0.8
            assert not ids & set(range(100, 105))
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
            assert ids == {w[0] for w in decontaminate.brute_force([(r.doc_id, r.text) for r in before], items) if not w[5]} and 400 not in ids
        if name == "tokens":
            texts = {r.doc_id: r.text or "" for r in before}
            assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
            assert all(len(r.token_ids) == r.n_tokens for r in rows)
        docs = spark.createDataFrame(rows, out.schema) if rows else out
    assert corpus_pipeline.run(spark, corpus).count() == docs.count()


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_near_copies_with_edits_go(spark):
    """Copies with edited words, down to a shingle similarity of 0.8, are one group; looser ones stay."""
    rng = random.Random(7)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(300)]
        rows.append((100 * g, " ".join(base)))
        for k, edits in enumerate((1, 2, 4, 5, 6, 20, 60)):
            text = list(base)
            for at in rng.sample(range(300), edits):
                text[at] = f"edit{rng.random()}"
            rows.append((100 * g + k + 1, " ".join(text)))
        for k in range(8):  # a chain: each like the next one only
            rows.append((100 * g + 50 + k, " ".join([f"c{g}w{i}" for i in range(10 * k, 10 * k + 200)])))
    rows += [(9000, None), (9001, ""), (9002, "a B c"), (9003, "a b  C"), (9004, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in near_copies.keep_one(docs).collect()}
    assert got == near_copies.brute_force(rows)
    assert {100 * g + k for g in range(12) for k in (1, 2, 3)}.isdisjoint(got) and {100 * g + 7 for g in range(12)} <= got
    crowd = [(i, " ".join(f"c{k}" if rng.random() > 0.12 else f"own{i}x{k}" for k in range(40))) for i in range(300)]  # half alike: no links, few candidates
    crowd += [(1000 + i, " ".join(f"d{k}" if k != i else "x" for k in range(60))) for i in range(60)]  # one edit each
    assert {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(crowd, "doc_id long, text string")).collect()} == near_copies.brute_force(crowd)
    staged = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert {r.doc_id for r in staged.collect()} == got
