from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sessionlake.functions import text as T
from sessionlake.operators import exchange, ingest, relevance, requests, search
from sessionlake.plans import catalog
from sessionlake.sources import bundles

DATA = Path("/root/testdata/sf0.001")
PERSON = "ann"


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(([show(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    got = entry.queries()[name](spark, str(DATA))
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert normal(map(tuple, got.collect()), got.columns) == normal(want.fetchall(), names)


def session(spark, *rows):
    """sessions (session_id, uuid, ended_at, repository, export_path) as a bundle brings them, with bodies by entry."""
    sessions, entries = [], []
    for i, (sid, uuid, ended, repository, bodies) in enumerate(rows):
        sessions.append((sid, i, "codex", uuid, repository, f"x/{uuid}.json", "2026-01-01T00:00:00Z", ended, None, "fb-" + uuid))
        entries += [(sid, seq, "user", None, f"### [{seq:04d}] role=user", b) for seq, b in enumerate(bodies)]
    s = spark.createDataFrame(sessions, "session_id long, arrival long, source string, uuid string, repository string, export_path string, started_at string, ended_at string, entry_count int, session_fallback string")
    e = spark.createDataFrame(entries, "session_id long, seq int, role string, ts string, header_line string, body string") if entries else spark.createDataFrame([], "session_id long, seq int, role string, ts string, header_line string, body string")
    mapped, bodies = ingest.content_address(e)
    mapped = mapped.withColumn("body_sha256", F.col("blob_hash"))
    prints = ingest.session_fingerprints(s, mapped).withColumnRenamed("fingerprint", "session_fingerprint")
    key = T.session_key(F.col("source"), F.col("uuid"), F.col("started_at"), F.col("session_fallback"))
    s = s.join(prints, "session_id").withColumn("session_key", key).withColumn("cwd", F.lit("/w"))
    return s, mapped, bodies


def empty(spark):
    make = lambda schema: spark.createDataFrame([], schema)
    return ingest.Corpus(
        make("session_id long, person string, source string, uuid string, repository string, export_path string, cwd string, started_at string, ended_at string, entry_count int, is_subagent boolean, session_fingerprint string, session_key string"),
        make("session_id long, seq int, role string, ts string, header_line string, blob_hash string"), make("blob_hash string, nbytes long, nrefs long"),
        make("blob_hash string, body string"), make("export_path string, reason string, cwd string"),
    )


def reasons(corpus):
    return sorted(r.reason for r in corpus.skipped.collect())


def test_merge_import(spark, tmp_path):
    allow = spark.createDataFrame([("GitHub.com/a/b",)], "repository string")
    first = session(spark, (1, "u1", "2026-01-02T00:00:00Z", "github.com/a/b", ["same", "one"]), (2, "u2", None, "github.com/a/b", ["same"]), (3, "u3", None, "github.com/x/y", ["no"]))
    assert ingest.verify_session_identity(first[0], first[1]).count() == 0
    corpus = ingest.merge_import(empty(spark), *first, PERSON, allow)
    assert corpus.sessions.count() == 2 and reasons(corpus) == ["repository_not_allowed"]
    assert {(r.blob_hash[:2], r.nrefs) for r in corpus.blobs.collect()} == {(T_sha("same")[:2], 2), (T_sha("one")[:2], 1)}
    bundles.write_snapshot(corpus, str(tmp_path / "corpus"))
    corpus = bundles.read_snapshot(spark, str(tmp_path / "corpus"))
    # a newer generation replaces u1 and its entries, the repeat of u2 is known content, an older generation of u1 is stale
    second = session(spark, (11, "u1", "2026-01-03T00:00:00Z", "github.com/a/b", ["same", "two"]), (12, "u2", None, "github.com/a/b", ["same"]), (13, "u1", "2026-01-01T12:00:00Z", "github.com/a/b", ["old"]))
    after = ingest.merge_import(corpus, *second, PERSON, allow)
    assert sorted(r.session_id for r in after.sessions.collect()) == [2, 11]
    assert reasons(after) == ["duplicate_session_content", "repository_not_allowed", "stale_session_generation"]
    counts = {r.blob_hash: r.nrefs for r in after.blobs.collect()}
    assert counts == {T_sha("same"): 2, T_sha("one"): 0, T_sha("two"): 1}
    # the same bundle again changes nothing; another person's copy is theirs
    again = ingest.merge_import(after, *session(spark, (21, "u1", "2026-01-03T00:00:00Z", "github.com/a/b", ["same", "two"])), PERSON, allow)
    assert sorted(r.session_id for r in again.sessions.collect()) == [2, 11]
    other = ingest.merge_import(after, *session(spark, (31, "u2", None, "github.com/a/b", ["same"])), "bob", None)
    assert other.sessions.count() == 3


def T_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_identity_violations(spark):
    s, e, _ = session(spark, (1, "u1", None, "r", ["a"]), (2, "u2", None, "r", ["b"]))
    s = s.withColumn("session_key", F.when(F.col("session_id") == 1, "forged").otherwise(F.col("session_key"))).withColumn("session_fallback", F.when(F.col("session_id") == 1, F.col("session_fallback")))
    got = sorted(map(tuple, ingest.verify_session_identity(s, e).collect()))
    assert got == [(1, "session_key_mismatch"), (2, "missing_session_fallback"), (2, "session_key_mismatch")]


def test_backfill_fingerprints(spark):
    s, e, _ = session(spark, (1, "u", None, "r", ["a"]), (2, "u", None, "r", ["a"]), (3, "v", None, "r", ["a"]))
    s = s.withColumn("person", F.lit("p")).withColumn("session_fingerprint", F.lit(None).cast("string"))
    kept, entries = ingest.backfill_fingerprints(s, e)
    assert sorted(r.session_id for r in kept.collect()) == [1, 3] and sorted(r.session_id for r in entries.collect()) == [1, 3]


def test_fingerprint_is_canonical(spark):
    import hashlib
    import json

    s, e, _ = session(spark, (1, 'u"é', None, "r", ["a", "b\x1f"]))
    rows = sorted(e.collect(), key=lambda r: r.seq)
    payload = {"entries": [{"body_sha256": r.body_sha256, "header_line": r.header_line, "role": r.role, "seq": r.seq, "ts": r.ts} for r in rows], "source": "codex", "uuid": 'u"é'}
    want = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert s.first().session_fingerprint == want


def test_phrases_and_terms(spark):
    bodies = spark.createDataFrame([("1", "vector / compaction of things"), ("2", "compaction vector"), ("3", "aws_iam_user deploys"), ("4", "aws user iam")], "blob_hash string, body string")
    postings = ingest.build_postings(bodies)

    def found(q, p=postings):
        return sorted(r.blob_hash for r in search.match_query(p, q).collect())

    assert found("vector compaction") == ["1", "2"] and found('"vector compaction"') == ["1"] and found("vector/compaction") == ["1"] and found("aws_iam_user") == ["3"]
    with pytest.raises(ValueError):
        search.match_query(postings, "the of a")
    assert search.parse_query("'a b'") == (["a b"], True) and search.parse_query("how to x fix it NOT") == (["fix", "NOT"], False)
    stems = ingest.build_postings(spark.createDataFrame([("1", "Déploys déployed")], "blob_hash string, body string"), "porter")
    assert sorted(r.term for r in stems.collect()) == ["deploi"]


@pytest.mark.parametrize("analyzer", ["simple", "porter"])
def test_postings_call_python_once(spark, tmp_path, analyzer):
    """A body's words are gathered by one call of Python, also where the bodies are a stored table and the index is asked for some words."""
    rows = [("1", "things and Things"), ("2", ""), ("3", None), ("4", "resting... things")]
    spark.createDataFrame(rows, "blob_hash string, body string").write.parquet(str(tmp_path / "bodies"))
    postings = ingest.build_postings(spark.read.parquet(str(tmp_path / "bodies")), analyzer).where("term like 'thing%'")
    assert postings._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = sorted((r.blob_hash, r.term, tuple(r.positions)) for r in postings.collect())
    assert got == ([("1", "thing", (0, 2)), ("4", "thing", (1,))] if analyzer == "porter" else [("1", "things", (0, 2)), ("4", "things", (1,))])


def test_import_shuffles_no_text_for_sizes_and_no_sets_for_homes(spark, tmp_path):
    """Sizes of new bodies come from narrow rows, and the directory's homes from a number for each term; both are right."""
    s, e, b = session(spark, (1, "u1", None, "r", ["same é", "one"]), (2, "u2", None, "r", ["same é"]))
    b.unionByName(b).write.parquet(str(tmp_path / "bodies"))
    delta = ingest.import_delta(empty(spark), s, e, spark.read.parquet(str(tmp_path / "bodies")), PERSON, None)
    plan = delta.blobs._jdf.queryExecution().optimizedPlan().toString()
    assert "first(body" not in plan and {(r.nbytes, r.nrefs) for r in delta.blobs.collect()} == {(7, 2), (3, 1)}
    assert sorted(r.body for r in delta.bodies.collect()) == ["one", "same é"]
    rows = spark.createDataFrame([(1, "t", f"h{i}") for i in range(300)] + [(1, "u", "h7")], "bucket int, term string, blob_hash string")
    found = ingest.term_directory(rows)
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    home = rows.where("blob_hash = 'h7'").select(ingest.home_of(F.col("blob_hash")).alias("home")).first().home
    assert {r.term: (r.df, r.homes) for r in found.collect()} == {"t": (300, list(range(32))), "u": (1, [home])}


def test_resolve_and_read(spark):
    s = spark.createDataFrame([(1, "abc", "p", False, "t1"), (2, "abd", "q", False, "t2"), (3, "ab/sub", "p", True, "t3")], "session_id long, uuid string, person string, is_subagent boolean, started_at string")
    one, several = search.resolve_session(s, uuid="AB")
    assert one.count() == 0 and [r.session_id for r in several.collect()] == [2, 1]
    assert [r.session_id for r in search.resolve_session(s, uuid="ab", person="p")[0].collect()] == [1]
    assert [r.session_id for r in search.resolve_session(s, uuid="abd")[0].collect()] == [2]
    assert [r.session_id for r in search.resolve_session(s, session_id=3)[0].collect()] == [3]


def test_latency(spark):
    three = spark.createDataFrame([(2.0,), (3.0,), (4.0,)], "duration_ms double")
    assert tuple(requests.latency_quantiles(three).first()) == (3.0, 3.0, 4.0)
    assert tuple(requests.latency_quantiles(three.limit(0)).first()) == (None, None, None)
    many = spark.range(1000).selectExpr("if(id % 3 = 0, null, cast(id % 250 as double) / 8) as duration_ms")
    known = sorted(r.duration_ms for r in many.where("duration_ms is not null").collect())
    at = lambda f: round(known[int((len(known) - 1) * f)], 3)
    assert tuple(requests.latency_quantiles(many, {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}).first()) == (*map(at, (0.0, 0.5, 0.95, 0.99, 1.0)), known[-1])


def test_upload_states(spark):
    events = [("u", i, e, "o", 10, float(i)) for i, e in enumerate(["prepare", "receive", "received", "commit", "receive", "process", "complete", "cancel", "prepare"])]
    events += [("v", 0, "prepare", "o", 5, 0.0), ("v", 1, "cancel", "o", 5, 1.0)]
    df = spark.createDataFrame(events, "upload_id string, event_no int, event string, owner string, nbytes long, at double")
    got = {r.upload_id: (r.status, r.rejected) for r in requests.upload_state(df).collect()}
    assert got == {"u": ("prepared", 2), "v": ("cancelled", 0)}
    state = requests.upload_state(df)
    asked = spark.createDataFrame([("u", "o", 99), ("v", "o", 5), ("w", "o", 1), ("x", "p", 5)], "upload_id string, owner string, nbytes long")
    over = requests.quota_violations(state, asked, 14).collect()  # u is pending itself; v would add 5 to 10, w only 1
    assert [(r.upload_id, r.pending_bytes, r.asked_bytes) for r in over] == [("v", 10, 5)]
    assert requests.pending_bytes(state, but="u").count() == 0


def test_empty_corpus(spark):
    c = empty(spark)
    assert search.coverage(c.sessions).count() == 0
    assert tuple(search.storage_totals(c.blobs).first()) == (0, 0, 0)
    from sessionlake.operators import reports

    assert reports.dedup_totals(c.sessions, c.entries, c.skipped, c.blobs).first().saved_ratio == 0.0


def test_imports_and_density(spark):
    markers = spark.createDataFrame([("t1", "a", "1"), ("t2", "b", "2")], "thread_id string, source_path string, imported_at string")
    sessions = spark.createDataFrame([("t2", "/p/q")], "session_id string, cwd string")
    assert [(r.thread_id, r.cwd) for r in relevance.list_imports(markers, sessions).collect()] == [("t2", "/p/q"), ("t1", None)]
    scores = spark.createDataFrame([(1, 1, 5, 100, 1.0), (2, 1, 4, 5, 1.0)], "session_id int, coverage int, match_count int, total_messages int, sort_ts double")
    assert [r.session_id for r in relevance.rank_conversations(scores, 2, by_density=True).collect()] == [2, 1]
    assert exchange.present_count(markers.select(F.col("thread_id").alias("fingerprint")), spark.createDataFrame([("p", "t1")], "person string, session_fingerprint string"), "p").first()[0] == 1


def test_search_pushes_filters_down(spark):
    t = catalog.tables(spark, str(DATA))
    plan = search.find_hits(t["blobs"].select("blob_hash"), t["entries"], t["sessions"], roles=["user"])._jdf.queryExecution().toString()
    assert "Cartesian" not in plan


def _tables(spark, tmp_path):
    """Forty conversations of two turns and one document session; the terms are only in later turns and in the documents."""
    at = tmp_path / "small"
    spark.range(80).selectExpr("id div 2 conv_id", "id % 2 turn", "'user' role", "if(id % 2 = 1 and id >= 70, 'The nation', 'no') text").write.parquet(str(at / "conversations.parquet"))
    spark.range(8).selectExpr("id doc_id", "'The nation' text").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([], "event_id long, ts string, user_id long, event_type string, value double, props string").write.parquet(str(at / "events.parquet"))
    return str(at)


def test_budget_of_ranked_conversations(spark, tmp_path):
    rows = catalog.QUERIES["budget_blocks_ranked"](spark, _tables(spark, tmp_path)).collect()
    assert {r.session_id for r in rows} == {*range(35, 40), 1_000_000} and {r.rank for r in rows if r.session_id == 1_000_000} == {1}


def test_prompts_of_every_turn(spark, tmp_path):
    rows = catalog.QUERIES["search_prompts_all"](spark, _tables(spark, tmp_path)).collect()
    assert {(r.session, r.seq) for r in rows} == {*((i, 1) for i in range(35, 40)), (1_000_000, 0), (1_000_000, 4)}


def test_entry_without_the_pipeline_operators(tmp_path):
    """Their folders are gone, or only a cache folder of them is left: the rest imports."""
    import shutil
    import subprocess
    import sys

    root = Path(entry.__file__).parent
    for left_over in (False, True):
        at = tmp_path / str(left_over)
        shutil.copytree(root / "sessionlake", at / "sessionlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", at)
        if (root / "corpus_pipeline.py").exists():
            shutil.copy(root / "corpus_pipeline.py", at)
        if left_over:
            (at / "sessionlake/llm/__pycache__").mkdir(parents=True)
        told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=at, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, timeout=120)
        assert told.stdout.split() == [str(len(catalog.QUERIES)), "False"], told.stderr[-500:]


def test_stored_index_is_read_by_bucket(spark, tmp_path):
    bodies = spark.createDataFrame([("1", "They were deploying services"), ("2", "Déployed, at rest"), ("3", "nothing")], "blob_hash string, body string")
    bundles.write_postings(ingest.build_postings(bodies, "porter"), str(tmp_path / "index"))
    index = bundles.read_postings(spark, str(tmp_path / "index"))
    for query, want in {"deploying": ["1", "2"], "deploys services": ["1"], '"deployed service"': ["1"], "rests": ["2"]}.items():
        found = search.match_query(index, query, "porter")
        assert sorted(r.blob_hash for r in found.collect()) == want, query
    plan = search.match_terms(index, ["deploying"], "porter")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "EqualTo(term,deploi)" in plan


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def _gone(spark, before):
    """Whether all shuffle files but those of ``before`` are deleted, which takes a moment."""
    import time

    return any(not _shuffle_files(spark) - before or time.sleep(0.2) for _ in range(50))


def test_stored_index_names_each_body_once(spark, tmp_path):
    """Its rows are those of the index as built, for a few bytes each, and nothing that it was written with stays."""
    import random

    draw = random.Random(7)
    texts = [" ".join(f"w{draw.randrange(4000)}" for _ in range(300)) for _ in range(300)] + ["", "Things resting, things", "things rested"]
    rows = [*((T_sha(x), x) for x in texts), (None, None), (T_sha("things rested"), "things rested")]
    bodies, root = spark.createDataFrame(rows, "blob_hash string, body string"), tmp_path / "index"
    plain = lambda df: sorted((r.bucket, r.term, r.blob_hash, tuple(r.positions)) for r in df.collect())
    built = ingest.build_postings(bodies, "porter")
    want = plain(built)
    before = _shuffle_files(spark)
    bundles.write_homes(bodies, str(tmp_path / "homes"), once=True)
    bundles.write_index(bodies, str(root / "v=1"), "porter")
    bundles.write_terms(spark, str(root / "v=1"), str(tmp_path / "terms"))
    assert _gone(spark, before)
    stored = bundles.read_postings(spark, str(root / "v=1"))
    assert plain(stored) == want and sum(p.stat().st_size for p in root.rglob("*.parquet")) < 16 * len(want)
    assert {r.blob_hash: r.home for r in stored.collect()} == {r.blob_hash: r.home for r in built.select("blob_hash", ingest.home_of(F.col("blob_hash")).alias("home")).collect()}
    directory = lambda df: sorted((r.bucket, r.term, r.df, tuple(r.homes)) for r in df.collect())
    assert directory(bundles.read_terms(spark, str(tmp_path / "terms"))) == directory(ingest.term_directory(built))
    assert sorted(r.blob_hash or "" for r in bundles.read_homes(spark, bundles.BODIES, str(tmp_path / "homes")).collect()) == sorted({h or "" for h, _ in rows})
    bundles.write_postings(built, str(root / "v=2"))
    assert plain(bundles.read_postings(spark, str(root / "v=2"))) == want
    bundles.merge_indexes(spark, [str(root / "v=1"), str(root / "v=2")], str(root / "v=3"))
    assert plain(bundles.read_postings(spark, str(root / "v=3"))) == sorted(want * 2)
    assert plain(bundles.read_postings(spark, *(str(root / f"v={n}") for n in (1, 2)))) == sorted(want * 2)


def test_segments_of_an_index(monkeypatch):
    """Words are dealt to segments by their bytes; each segment's rows give back its words' places."""
    import pyarrow as pa

    monkeypatch.setattr(ingest, "MOST_SEGMENT", 100)
    words = [["b", "a", "b"], None, [], ["é", "a"], ["a"] * 40, ["c"]]
    batch = pa.record_batch([pa.array([f"h{i}" for i in range(6)]), pa.array(words, pa.list_(pa.string()))], ["blob_hash", "words"])
    got, parts = {}, list(ingest._of_words(iter([batch, batch.slice(0, 0)]), "simple"))
    for n, part in enumerate(parts):
        rows = ingest.segment_rows(*part, 1, n).to_pylist() if len(part[0]) else []
        names = {r["numbers"][0]: r["term"] for r in rows if r["bucket"] < 0}
        assert [r["bucket"] for r in rows if r["bucket"] >= 0] == sorted(ingest.bucket_of(r["term"]) for r in rows if r["bucket"] >= 0)
        for r in (r for r in rows if r["bucket"] >= 0):
            for number, a, b in zip(r["numbers"], [0, *r["ends"]], r["ends"]):
                got[names[number], r["term"]] = r["places"][a:b]
    assert len(parts) > 1
    assert got == {("h0", "a"): [1], ("h0", "b"): [0, 2], ("h3", "é"): [0], ("h3", "a"): [1], ("h4", "a"): list(range(40)), ("h5", "c"): [0]}


def test_refused_bundles(spark, tmp_path):
    """Each broken rule refuses the whole bundle and leaves the corpus as it was; a known bundle only renews its ledger row."""
    from sessionlake.streaming import ledger

    root, n = str(tmp_path / "corpus"), iter(range(100))

    def offer(s, e, b):
        path = str(tmp_path / f"b{next(n)}")
        bundles.write_bundle(s, e, b, path)
        return ledger.ingest_one(spark, root, path, PERSON, None, lambda: empty(spark))

    good = session(spark, (1, "u1", None, "R/X", ["a", "b"]), (2, "u2", None, "r", ["c"]))
    assert offer(*good) == "imported" and offer(*good) == "replayed"
    s, e, b = session(spark, (11, "u3", None, "r", ["d", "e"]))
    for bad in (
        (s.withColumn("session_fallback", F.lit("")), e, b), (s.withColumn("session_key", F.lit("0" * 64)), e, b), (s.withColumn("session_fingerprint", F.lit("0" * 64)), e, b),
        (s, e.withColumn("seq", F.lit(0)), b), (s, e, b.withColumn("body", F.concat("body", F.lit("!")))), (s, e, b.where("body = 'd'")),
    ):
        with pytest.raises(ingest.BundleRefused):
            offer(*bad)
    corpus = bundles.read_snapshot(spark, root)
    assert sorted((r.session_id, r.repository) for r in corpus.sessions.collect()) == [(1, "r/x"), (2, "r")] and corpus.skipped.count() == 0
    assert [(r.sessions_kept, r.sessions_skipped) for r in corpus.imports.collect()] == [(2, 0)]
    (tmp_path / "corpus/commits/000000000099.json").write_text("{")  # a commit that was never finished
    assert bundles.read_snapshot(spark, root).sessions.count() == 2
    plain = session(spark, (21, "u4", None, "r", ["f"]))
    named = ingest.with_defaults(plain[0].withColumn("uuid", F.lit("")).withColumn("source", F.lit(None).cast("string")).withColumn("export_path", F.lit("a/u9__x__y.json"))).first()
    assert (named.uuid, named.source) == ("u9", "unknown")
    assert search.search_corpus(corpus, "'c'").first().uuid == "u2"


def test_repaired_bundles_are_imported(spark, tmp_path):
    """A bundle that comes again with what it lacked, or with another end, is another bundle; an equal one, in any order, is a replay."""
    from sessionlake.streaming import ledger

    root, n = str(tmp_path / "corpus"), iter(range(100))

    def offer(s, e, b):
        path = str(tmp_path / f"b{next(n)}")
        bundles.write_bundle(s, e, b, path)
        return ledger.ingest_one(spark, root, path, PERSON, None, lambda: empty(spark))

    s, e, b = session(spark, (1, "u1", None, "r", ["a", "b"]), (2, "u2", None, "r", ["c"]))
    assert offer(s, e.where("session_id = 1"), b) == "imported"
    assert [r.uuid for r in bundles.read_snapshot(spark, root).sessions.collect()] == ["u1"]
    assert offer(s, e, b) == "imported"
    assert sorted(r.uuid for r in bundles.read_snapshot(spark, root).sessions.collect()) == ["u1", "u2"]
    assert offer(s.orderBy(F.desc("session_id")), e.orderBy(F.desc("body_sha256")), b.orderBy("body")) == "replayed"
    assert offer(s.withColumn("ended_at", F.lit("2026-05-01T00:00:00Z")), e, b) == "imported"
    rows = spark.createDataFrame([(1, "x")], "session_id long, k string")
    twice = rows.unionByName(rows)
    digests = {ingest.bundle_digest(a, c, b) for a in (rows, twice, rows.limit(0), twice.unionByName(rows), rows.withColumn("k", F.lit(None).cast("string"))) for c in (e, e.limit(0))}
    assert len(digests) == 10


def test_imports_leave_no_shuffle_files(spark, tmp_path):
    """What an import has shuffled is gone when it is done, imported or replayed; bodies that are written in rounds are all there, once."""
    from sessionlake.streaming import ledger

    s, e, b = session(spark, (1, "u1", None, "r", ["a", "b"]), (2, "u2", None, "r", ["c"]))
    before = _shuffle_files(spark)
    bundles.write_bundle(s, e, b.unionByName(b), str(tmp_path / "bundle"))
    for want in ("imported", "replayed"):
        assert ledger.ingest_one(spark, str(tmp_path / "corpus"), str(tmp_path / "bundle"), PERSON, None, lambda: empty(spark)) == want
    assert _gone(spark, before)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    rows = spark.createDataFrame([*((T_sha(str(i)), str(i)) for i in range(200)), (None, None)], "blob_hash string, body string")
    for rounds in (1, 4):
        bundles.write_homes(rows, str(tmp_path / f"homes{rounds}"), rounds=rounds)
        found = bundles.read_homes(spark, bundles.BODIES, str(tmp_path / f"homes{rounds}"))
        assert sorted((r.blob_hash or "", r.body) for r in found.collect()) == sorted((r.blob_hash or "", r.body) for r in rows.collect())


def test_quota_looks_at_failed_uploads(spark):
    uploads = spark.createDataFrame([("a", "p", "failed", 60), ("b", "p", "queued", 50), ("c", "q", "failed", 90), ("a", "q", "complete", 5)], "upload_id string, owner string, status string, nbytes long")
    asked = spark.createDataFrame([("a", "p", 40), ("b", "p", 999), ("c", "q", 100), ("a", "q", 11), ("new", "r", 101), ("new", "p", 0)], "upload_id string, owner string, nbytes long")
    got = requests.quota_violations(uploads, asked, 100)
    assert sorted(map(tuple, got.select("upload_id", "owner", "pending_bytes", "asked_bytes").collect())) == [("a", "q", 90, 11), ("new", "p", 110, 0), ("new", "r", 0, 101)]


def _scans(df):
    """The files that each scan of a finished query has read, by the name of the table's folder."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, nodes = {}, [plan]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            path = node.relation().location().rootPaths().head().toString()
            files = node.metrics().get("numFiles").get().value()
            found.setdefault(path.split("/corpus/")[1].split("/")[0], []).append(files)
        children = [node.plan()] if name.endswith("QueryStageExec") else [node.children().apply(i) for i in range(node.children().size())]
        nodes += children
    return found


def test_search_reads_matched_homes_only(spark, tmp_path):
    """Postings by bucket; entries and bodies in the homes of the bodies that hold all words."""
    texts = [f"common words and rare{i} ones, twice rare{i} ones" for i in range(120)] + ["common rare7 here", "common alone"]
    s, e, b = session(spark, *[(i, f"u{i}", None, "r", [x]) for i, x in enumerate(texts)])
    bundles.write_snapshot(ingest.merge_import(empty(spark), s, e, b, PERSON, None), str(tmp_path / "corpus"))
    corpus = bundles.read_snapshot(spark, str(tmp_path / "corpus"))
    for query, want in {"common rare7": {7, 120}, '"rare9 ones"': {9}, '"ones twice rare5 ones"': {5}, "rare7 rare8": set(), "nowhere": set(), '"ones rare9"': set()}.items():
        found = search.search_corpus(corpus, query)
        assert {r.session_id for r in found.collect()} == want, query
        read = _scans(found)
        homes = {r.home for r in corpus.bodies.where(F.col("blob_hash").isin([r.blob_hash for r in e.where(F.col("session_id").isin(list(want) or [-1])).collect()])).collect()}
        assert sum(read.get("entries", [])) <= max(len(homes), 4) and sum(read.get("bodies", [])) <= max(len(homes), 4), (query, read, homes)
    every = _scans(search.search_corpus(corpus, "common"))
    assert every["entries"] == [32]
    rows = {r.term: r for r in corpus.terms.collect()}
    assert rows["common"].df == 122 and len(rows["common"].homes) == 32 and rows["rare9"].df == 1


def test_versions_are_merged_by_level(spark, tmp_path):
    """Many imports leave few versions; older commits still read; what fails between write and commit leaves nothing."""
    root = str(tmp_path / "corpus")
    tables = {t: tmp_path / "corpus" / t for t in bundles.TABLES}
    corpus, names = empty(spark), []
    for n in range(5):
        s, e, b = session(spark, (100 + n, f"u{n % 3}", f"2026-01-0{1 + n}T00:00:00Z", "r", ["same", f"text {n}"]))
        before = bundles.read_versions(spark, root, names) if names else corpus
        imports = spark.createDataFrame([(PERSON, f"d{n}", f"t{n}", 1, 0)], ingest.IMPORTS)
        imports = before.imports.unionByName(imports) if names else imports
        version = bundles.write_delta(ingest.import_delta(before, s, e, b, PERSON, None), imports, root)
        bundles.commit(spark, root, [*names, version])
        names = bundles.settle(spark, root)
        assert len(names) < bundles.FANOUT
    assert [bundles.level_of(v) for v in names] == [1, 0]
    now = bundles.read_snapshot(spark, root)
    assert sorted(r.session_id for r in now.sessions.collect()) == [102, 103, 104] and now.imports.count() == 5
    assert {r.blob_hash: r.nrefs for r in now.blobs.collect()} == {T_sha("same"): 3} | {T_sha(f"text {n}"): int(n > 1) for n in range(5)}
    assert {r.session_id for r in search.search_corpus(now, "'text 3'").collect()} == {103} and now.bodies.count() == 6
    past = bundles.commits(spark, root)
    early = bundles.read_snapshot(spark, root, min(past))
    assert [r.session_id for r in early.sessions.collect()] == [100]
    kept = bundles.read_snapshot(spark, root, sorted(past)[-2])
    bundles.vacuum(spark, root, keep=2)
    assert sorted(bundles.commits(spark, root)) == sorted(past)[-2:] and kept.sessions.count() >= 1
    held = {v for names_ in bundles.commits(spark, root).values() for v in names_}
    assert all({p.name for p in at.iterdir() if p.name.startswith("v=")} == held for at in tables.values())
    left = {t: sorted(p.name for p in at.iterdir()) for t, at in tables.items()}
    broken = ingest.import_delta(now, *session(spark, (200, "u9", None, "r", ["x"])), PERSON, None)
    bad = broken.skipped.withColumn("reason", F.raise_error(F.lit("lost")).cast("string")).unionByName(spark.createDataFrame([("p", "r", "c")], "export_path string, reason string, cwd string").withColumn("reason", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        bundles.write_delta(ingest.replace(broken, skipped=bad), now.imports, root)
    assert left == {t: sorted(p.name for p in at.iterdir()) for t, at in tables.items()}
    written = bundles.write_delta(broken, now.imports, root)  # and then the driver is lost before the commit
    assert bundles.vacuum(spark, root) == [written] and bundles.read_snapshot(spark, root).sessions.count() == 3
    assert left == {t: sorted(p.name for p in at.iterdir()) for t, at in tables.items()}
