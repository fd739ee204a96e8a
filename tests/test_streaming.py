import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sessionlake.operators.ingest import Corpus
from sessionlake.operators.requests import upload_state
from sessionlake.sources import growing_logs
from sessionlake.sources.bundles import read_snapshot, write_bundle
from sessionlake.streaming import captures, ledger
from tests.test_operators import empty, session
from tests.test_sources import CAPTURE


def run(df, mode, tmp_path, **options):
    name = f"t{uuid.uuid4().hex[:8]}"
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers would keep the query going
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def streamed(spark, tmp_path, name, df):
    path = str(tmp_path / name)
    df.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_request_counts(spark, tmp_path):
    rows = [("r1", 0, "a"), ("r1", 0, "a"), ("r2", 5, "b"), ("r3", 6, "a")]
    df = spark.createDataFrame(rows, "request_id string, s int, actor string").select("request_id", "actor", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("started_at"), *[F.lit(None).cast("string").alias(c) for c in ("identity_kind", "mcp_name", "status_code", "error_code")])
    out = run(ledger.stream_request_counts(streamed(spark, tmp_path, "in", df)), "update", tmp_path)
    assert {(r.value, r.n) for r in out.where("dimension = 'actor'").collect()} == {("a", 2), ("b", 1)}


def test_upload_state(spark, tmp_path):
    rows = [("u", i, e, "o", 10, float(i)) for i, e in enumerate(["prepare", "receive", "received", "commit"])]
    df = spark.createDataFrame(rows, "upload_id string, event_no int, event string, owner string, nbytes long, at double")
    out = run(ledger.stream_upload_state(streamed(spark, tmp_path, "in", df)), "update", tmp_path)
    assert [(r.upload_id, r.status, r.rejected) for r in out.collect()] == [("u", "queued", 0)]


def test_uploads_share_groups_of_state(spark, tmp_path):
    """Three thousand uploads in two batches, some with nulls: states as ``upload_state`` folds them, and far fewer groups than uploads."""
    steps = F.element_at(F.array(*map(F.lit, ("prepare", "receive", "received", "commit"))), (F.col("id") % 4 + 1).cast("int"))
    events = spark.range(3000 * 3).select(
        F.concat(F.lit("u"), F.floor(F.col("id") / 4).cast("string")).alias("upload_id"), F.col("id").alias("event_no"), steps.alias("event"),
        F.when(F.col("id") % 7 > 0, "o").alias("owner"), F.when(F.col("id") % 5 > 0, F.lit(1 << 60) + F.col("id")).alias("nbytes"), F.when(F.col("id") % 9 > 0, 1e9).alias("at"),
    )
    streamed(spark, tmp_path, "in", events.where("event_no % 4 < 2"))
    out, states = tmp_path / "out", []
    for batch in (None, events.where("event_no % 4 >= 2")):
        source = streamed(spark, tmp_path, "in", batch) if batch is not None else spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = ledger.stream_upload_state(source, late="100 years").writeStream.foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(out)))
        q = q.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    last = spark.read.parquet(str(out)).groupBy("upload_id").agg(F.max_by(F.struct("owner", "status", "nbytes", "updated_at", "rejected"), "n").alias("s")).select("upload_id", "s.*")
    want = upload_state(events)
    assert sorted(map(repr, last.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert 0 < max(states) <= 1024


def test_capture_messages(spark, tmp_path):
    df = spark.createDataFrame([("th", i, x) for i, x in enumerate(CAPTURE, 1)], "thread string, line_no int, line string")
    out = run(captures.stream_capture_messages(streamed(spark, tmp_path, "in", df)), "append", tmp_path)
    assert sorted((r.role, r.text, r.complete) for r in out.collect()) == [("assistant", "whole", True), ("user", "ask", True)]


def test_threads_share_groups_of_state(spark, tmp_path):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(CAPTURE, 1)], "line_no int, line string")
    df = spark.range(2500).select(F.concat(F.lit("th"), "id").alias("thread")).crossJoin(lines)
    out = str(tmp_path / "out")
    q = captures.stream_capture_messages(streamed(spark, tmp_path, "in", df)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = spark.read.parquet(out).groupBy("role", "text").agg(F.countDistinct("thread"), F.count("*")).collect()
    assert {tuple(r) for r in got if r.text != "partial"} == {("assistant", "whole", 2500, 2500), ("user", "ask", 2500, 2500)}
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2048


def drained(df, at):
    """Reads a stream of messages to its end, timers included, from where it was; all rows so far."""
    df.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    df.sparkSession.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")  # else a Python source gets one batch a run
    q = df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return sorted((r.thread, r.role, r.text, r.complete) for r in df.sparkSession.read.schema(df.schema).parquet(f"{at}/out").collect())


def test_growing_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    said = ("th", "user", "ask", True)
    text = "\n".join(CAPTURE) + "\n"
    half = text.index("lost") + 2
    read = lambda: captures.stream_capture_messages(captures.capture_log_lines(growing_logs.stream_raw_lines(spark, str(logs))))
    (logs / "th.jsonl").write_text(text[:half])
    (logs / "other.txt").write_text("no log\n")
    assert drained(read(), tmp_path) == [said]
    with open(logs / "th.jsonl", "a") as log:
        log.write(text[half:])
    whole = [("th", "assistant", "whole", True), said]
    assert drained(read(), tmp_path) == whole
    (logs / "old.jsonl").write_text(json.dumps({**json.loads(CAPTURE[1]), "captured_at": "2027-01-01T00:00:00Z"}) + "\n")
    whole = [("old", "user", "ask", True), ("th", "assistant", "partial", False), *whole]
    assert drained(read(), tmp_path) == whole  # a year later, what was open is due
    (logs / "late.jsonl").write_text(CAPTURE[1] + "\r\n\n")
    assert drained(read(), tmp_path) == [("late", "user", "ask", True), *whole]  # a year behind the others, and still read


def test_ranges_of_lines(tmp_path, monkeypatch):
    """However a file is cut into ranges, each line comes once, with its place; the last has no newline yet."""
    monkeypatch.setattr(growing_logs, "BLOCK", 3)
    content = b"one\n\nthree is longer\n" + "\u00e4\n".encode() + b"half"
    path = tmp_path / "log"
    path.write_bytes(content)
    want = [(0, b"one"), (4, b""), (5, b"three is longer"), (21, "\u00e4".encode())]
    store, name = growing_logs.open_store(f"file:{path}")
    for span in range(1, len(content) + 1):
        with store.open_input_file(name) as source:
            got = [x for at in range(0, len(content), span) for x in growing_logs.lines_ending_in(source, at, min(at + span, len(content)))]
        assert got == want, span


def test_spans_of_growing_files(monkeypatch):
    monkeypatch.setattr(growing_logs, "SPAN", 10)
    reader = growing_logs.GrowingLogsReader("x", "", None)
    spans = reader.partitions({"a": 5, "b": 7, "c": 9}, {"a": 27, "b": 7, "c": 3, "d": 0})
    assert [(s.path, s.start, s.end) for s in spans] == [("a", 5, 15), ("a", 15, 25), ("a", 25, 27), ("c", 0, 3)]


def test_many_small_files_share_partitions(tmp_path):
    for n in range(2000):
        (tmp_path / f"{n}.jsonl").write_bytes(b"first %d\nhalf" % n)
    reader = growing_logs.GrowingLogsReader(str(tmp_path), ".jsonl", StructType.fromDDL(growing_logs.FIELDS))
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) <= 2 * growing_logs.MOST_SPANS
    got = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted((r["file_path"], r["place"], r["line"]) for r in got) == sorted((str(tmp_path / f"{n}.jsonl"), 0, f"first {n}") for n in range(2000))


def test_forks_and_filter(spark, tmp_path):
    asked = [("c", "1", 0, "thread/fork", json.dumps({"ephemeral": True, "excludeTurns": True, "threadId": "pa", "cwd": "/w"})), ("c", "2", 0, "thread/fork", json.dumps({"ephemeral": True})), ("c", "3", 1, "turn/start", "{}")]
    told = [("c", "1", 1, json.dumps({"thread": {"id": "side"}, "model": "m"})), ("c", "2", 1, json.dumps({"thread": {"id": "x"}})), ("d", "1", 1, json.dumps({"thread": {"id": "y"}}))]
    a = spark.createDataFrame(asked, "connection string, id string, s int, method string, params string").withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    b = spark.createDataFrame(told, "connection string, id string, s int, result string").withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    got = captures.correlate_forks(streamed(spark, tmp_path, "a", a), streamed(spark, tmp_path, "b", b))
    assert list(map(tuple, run(got, "append", tmp_path).collect())) == [("side", "pa", "/w", "m")]
    rpc = spark.createDataFrame([("client_to_server", "x"), ("server_to_client", "noise"), ("server_to_client", None), ("server_to_client", "thread/y"), ("server_to_client", "a/requestApproval"), ("server_to_client", "error")], "direction string, method string")
    assert captures.filter_capture(rpc).count() == 5


def test_ingest_stream(spark, tmp_path):
    for n, rows in enumerate([[(1, "u1", None, "r", ["a"])], [(2, "u1", "2026-01-02T00:00:00Z", "r", ["a", "b"])], [(3, "u1", None, "r", ["a"])]]):
        write_bundle(*session(spark, *rows), str(tmp_path / f"b{n}"))
    queue = spark.createDataFrame([(n, str(tmp_path / f"b{n}"), "p") for n in range(3)], "queued_at int, path string, person string")
    root = str(tmp_path / "corpus")
    q = ledger.stream_ingest(streamed(spark, tmp_path, "queue", queue), root, str(tmp_path / "cp"), None, lambda: empty(spark))
    q.awaitTermination(200)
    corpus = read_snapshot(spark, root)
    assert isinstance(corpus, Corpus) and [r.session_id for r in corpus.sessions.collect()] == [2] and corpus.bodies.count() == 2
