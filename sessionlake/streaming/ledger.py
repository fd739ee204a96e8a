"""Streams of requests, uploads and bundles."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionlake.operators.ingest import IMPORTS, BundleRefused, Corpus, Delta, bundle_digest, bundle_violations, import_delta, import_ledger
from sessionlake.operators.requests import ABANDONED, DIMENSIONS, STATE, step
from sessionlake.sources.bundles import commit, delete, delete_version, read_bundle, read_versions, settle, shuffles_freed, vacuum, versions, write_delta


def stream_request_counts(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """dimension, value and n of a stream of requests (with started_at), for update mode; a repeated request_id within ``late`` counts once."""
    once = requests.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["request_id"])
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in DIMENSIONS])
    return once.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


_HELD = f"uploads array<struct<{', '.join(':'.join(c.split()) for c in STATE.split(', '))},due:long>>"


def stream_upload_state(events: DataFrame, ttl: int = 86_400_000, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """The state of each upload after every batch of its events (update mode); an abandoned one expires ``ttl`` milliseconds after its last event.

    Time is that of the events (``at``, in seconds), so a stream that is read again gives the same rows; an event more than ``late`` behind the newest is left out.
    No time, or one before 1970, counts as that year's first second, since a stream's watermark begins at 1970. Uploads are folded in ``buckets`` groups by a hash
    of their id, as a call of Python for each upload costs far more than its events; each has its own time at which it is due, its group the least of them.
    """
    names = [c.split()[0] for c in STATE.split(", ")]
    fields = [*names, "due"]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {u[0]: dict(zip(fields, u, strict=True)) for u in state.get[0]} if state.exists else {}
        now, told = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for event in pd.concat(list(parts)).sort_values("event_no").to_dict("records"):
                upload = event["upload_id"]
                event["nbytes"] = None if event["nbytes"] is None else int(event["nbytes"])  # a long beside a null would be a float
                held[upload] = step(held.get(upload), event)
                told.add(upload)
            for u in map(held.get, told):
                due = (0 if pd.isna(u["updated_at"]) else int(u["updated_at"] * 1000)) + ttl
                u["due"] = max(due, now + 1) if u["status"] in ABANDONED else None
        over = [u for u in held.values() if u["due"] is not None and u["due"] < now and u["upload_id"] not in told]
        for u in over:
            u["status"], u["due"] = "expired", None
        state.update(([tuple(u[f] for f in fields) for u in held.values()],))
        dues = [u["due"] for u in held.values() if u["due"] is not None]
        if dues:
            state.setTimeoutTimestamp(min(dues))
        rows = [*map(held.get, told), *over]
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)  # longs beside nulls stay longs

    timed = events.withColumn("event_time", F.timestamp_seconds(F.greatest("at", F.lit(1.0)))).withWatermark("event_time", late)
    dealt = timed.withColumns({"bucket": F.pmod(F.xxhash64("upload_id"), F.lit(buckets)), "nbytes": F.col("nbytes").cast("long").cast("string")})
    return dealt.groupBy("bucket").applyInPandasWithState(fold, STATE, _HELD, "update", GroupStateTimeout.EventTimeTimeout)


def ingest_one(spark: SparkSession, root: str, bundle: str, person: str, allow: DataFrame | None, empty: Callable[[], Corpus], now: str | None = None) -> str:
    """Import one bundle into the snapshot at ``root``: ``imported``, or ``replayed`` if the ledger has it, when only its row is renewed.

    A bundle that breaks a rule is refused as a whole (``BundleRefused``); that and any failure leave the snapshot as it was, and nothing behind: what an import
    has written is deleted when it fails, and what a lost driver left is deleted by the next. Versions are merged by level as they gather.
    """
    with shuffles_freed(spark):
        return _ingest_one(spark, root, bundle, person, allow, empty, now)


def _ingest_one(spark: SparkSession, root: str, bundle: str, person: str, allow: DataFrame | None, empty: Callable[[], Corpus], now: str | None) -> str:
    vacuum(spark, root)
    names = versions(spark, root)
    corpus = read_versions(spark, root, names) if names else empty()
    sessions, entries, bodies = read_bundle(spark, bundle)
    digest, at = bundle_digest(sessions, entries, bodies), now or datetime.now(UTC).isoformat()
    imports = corpus.imports if corpus.imports is not None else spark.createDataFrame([], IMPORTS)
    mine = (F.col("person") == person) & (F.col("archive_sha256") == digest)
    old = imports.where(mine).first()
    if old:
        renewed = import_ledger(imports, person, digest, sessions, corpus.sessions, old["imported_at"])
        none = Delta(*[getattr(corpus, t).limit(0) if t != "removed" else corpus.sessions.select("session_id").limit(0) for t in ("sessions", "removed", "entries", "blobs", "bodies", "skipped", "postings")])
        commit(spark, root, [*names, write_delta(none, renewed, root)])
        settle(spark, root)
        return "replayed"
    wrong = bundle_violations(corpus, sessions, entries, bodies, allow).orderBy("violation", "subject").limit(5).collect()
    if wrong:
        raise BundleRefused("; ".join(f"{r['violation']} ({r['subject']})" for r in wrong))
    work = f"{root}/work/{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(work)
        return spark.read.schema(df.schema).parquet(work)

    try:
        delta = import_delta(corpus, sessions, entries, bodies, person, allow, keep)
        counts = delta.sessions.agg(F.count("*").alias("sessions_kept")).join(delta.skipped.agg(F.count("*").alias("sessions_skipped")))  # one row each
        row = counts.select(F.lit(person).alias("person"), F.lit(digest).alias("archive_sha256"), F.lit(at).alias("imported_at"), "sessions_kept", "sessions_skipped")
        version = write_delta(delta, imports.unionByName(row), root)
        try:
            commit(spark, root, [*names, version])
        except BaseException:
            delete_version(spark, root, version)
            raise
    finally:
        delete(spark, work)
    settle(spark, root)
    return "imported"


REFUSED = "queued_at string, path string, person string, reason string"


def stream_ingest(queue: DataFrame, root: str, checkpoint: str, allow: DataFrame | None, empty: Callable[[], Corpus]) -> StreamingQuery:
    """Ingest a stream of queued bundles (queued_at, path, person), one at a time, oldest first.

    A batch that runs again finds its bundles in the ledger. Refused bundles are noted in ``root``/refused, by batch, and the stream goes on.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, refused = batch.sparkSession, []
        for row in batch.orderBy("queued_at", "path").toLocalIterator():  # a queue of bundles, not of their rows
            try:
                ingest_one(spark, root, row["path"], row["person"], allow, empty)
            except BundleRefused as error:
                refused.append((str(row["queued_at"]), row["path"], row["person"], str(error)))
        spark.createDataFrame(refused, REFUSED).write.mode("overwrite").parquet(f"{root}/refused/batch={number}")

    return queue.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
