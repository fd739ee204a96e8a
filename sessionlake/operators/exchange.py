"""Exchange between a client's bundle and the corpus: scope, missing parts, delta plans and manifests."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions import text as T

#: Fixed value: a delta of this share of the whole bundle or more isn't worth it.
REUSE_FROM = 0.8


def missing_sessions(fingerprints: DataFrame, sessions: DataFrame, person: str) -> DataFrame:
    """The given fingerprints (repeats kept) that aren't live for their owner."""
    live = sessions.where(F.col("person") == person).select(F.col("session_fingerprint").alias("fingerprint"))
    return fingerprints.join(live, "fingerprint", "left_anti")


def present_count(fingerprints: DataFrame, sessions: DataFrame, person: str) -> DataFrame:
    live = sessions.where(F.col("person") == person).select(F.col("session_fingerprint").alias("fingerprint")).distinct()
    return fingerprints.join(live, "fingerprint", "left_semi").agg(F.count("*").alias("present"))


def missing_bodies(hashes: DataFrame, bodies: DataFrame) -> DataFrame:
    """The given hashes that nobody has stored."""
    return hashes.join(bodies.select("blob_hash"), "blob_hash", "left_anti")


def plan_delta(bundle_sessions: DataFrame, bundle_entries: DataFrame, bundle_bodies: DataFrame, sessions: DataFrame, bodies: DataFrame, person: str) -> DataFrame:
    """One row: n_sessions and n_bodies to send, delta_bytes, whole_bytes and the mode: empty, whole or delta."""
    mine = sessions.where(F.col("person") == person).select("session_fingerprint")
    new = bundle_sessions.join(mine, "session_fingerprint", "left_anti").select("session_id")
    need = bundle_entries.join(new, "session_id", "left_semi").select("blob_hash").distinct()
    send = missing_bodies(need, bodies).join(bundle_bodies.select("blob_hash", F.octet_length("body").alias("size")), "blob_hash")
    counts = new.agg(F.count("*").alias("n_sessions")).join(send.agg(F.count("*").alias("n_bodies"), F.coalesce(F.sum("size"), F.lit(0)).alias("delta_bytes")))
    whole = bundle_bodies.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("whole_bytes")).join(bundle_sessions.agg(F.count("*").alias("all_sessions")))
    everything = (F.col("n_sessions") == F.col("all_sessions")) | (F.col("delta_bytes") >= REUSE_FROM * F.col("whole_bytes"))
    mode = F.when(F.col("n_sessions") == 0, "empty").when(everything, "whole").otherwise("delta")
    return counts.join(whole).select("n_sessions", "n_bodies", "delta_bytes", "whole_bytes", mode.alias("mode"))  # one row each


def scope_summary(sessions: DataFrame) -> DataFrame:
    """One row: sorted repositories and sources, sessions, side chats and side chats without an end."""
    side = F.coalesce(F.col("backend") == "side_chat", F.lit(False))
    return sessions.agg(
        F.array_join(F.array_sort(F.collect_set("repository")), ",").alias("repositories"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        F.count("*").alias("sessions"), F.count_if(side).alias("side_chats"),
        F.count_if(side & F.col("ended_at").isNull()).alias("incomplete_side_chats"),
    )


@dataclass(frozen=True)
class Scope:
    repositories: tuple[str, ...]
    sources: tuple[str, ...]
    session_count: int
    since: str | None = None
    until: str | None = None


def validate_scope(sessions: DataFrame, scope: Scope) -> DataFrame:
    """violation rows: everything in which a bundle's sessions differ from the declared scope."""
    spark = sessions.sparkSession

    def sets(column: str, declared: tuple[str, ...], name: str) -> DataFrame:
        told = spark.createDataFrame([(v,) for v in declared], f"{column} string").withColumn("told", F.lit(True))
        held = sessions.select(column).distinct().withColumn("held", F.lit(True))
        odd = held.join(told, column, "full").where("told is null or held is null")
        return odd.select(F.concat(F.lit(f"{name}:"), F.coalesce(column, F.lit("null"))).alias("violation"))

    total = sessions.agg(F.count("*").alias("n")).where(F.col("n") != scope.session_count).select(F.lit("session_count").alias("violation"))
    bounds = []
    if scope.since:
        bounds.append(F.when(F.col("ended_at").isNull(), "missing_end").when(T.sort_ts(F.col("ended_at")) < F.lit(_epoch(scope.since)), "before_since"))
    if scope.until:
        bounds.append(F.when(F.col("started_at").isNull(), "missing_start").when(T.sort_ts(F.col("started_at")) > F.lit(_epoch(scope.until)), "after_until"))
    bad_key = F.when(~F.coalesce(F.col("session_fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_fingerprint")
    rows = sessions.select(F.explode(F.array_compact(F.array(bad_key, *bounds))).alias("violation")).distinct()
    repeated = sessions.groupBy("session_fingerprint").count().where("count > 1").select(F.lit("repeated_fingerprint").alias("violation")).distinct()
    out = total.unionByName(rows).unionByName(repeated)
    return out.unionByName(sets("repository", scope.repositories, "repository")).unionByName(sets("source", scope.sources, "source"))


def _epoch(text: str) -> float:
    value = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return (value.replace(tzinfo=value.tzinfo or datetime.fromisoformat("2000-01-01T00:00:00+00:00").tzinfo)).timestamp()


def filter_export(
    sessions: DataFrame, project: str | None = None, since: str | None = None, until: str | None = None,
    repositories: list[str] | None = None, include_subagents: bool = True, include_archived: bool = True,
) -> DataFrame:
    """Sessions of an export: cwd holds the project in any case, the session overlaps the time bounds (a missing start is out
    when bounded; a missing end is the start), and the repository is listed."""
    start = T.sort_ts(F.col("started_at"))
    end = F.when(T.sort_ts(F.col("ended_at")) > 0, T.sort_ts(F.col("ended_at"))).otherwise(start)
    if project:
        sessions = sessions.where(F.contains(F.lower("cwd"), F.lit(project.lower())))
    if since or until:
        sessions = sessions.where(start > 0)
    if since:
        sessions = sessions.where(end >= _epoch(since))
    if until:
        sessions = sessions.where(start <= _epoch(until))
    if repositories is not None:
        sessions = sessions.where(F.lower("repository").isin([r.lower() for r in repositories]))
    sessions = sessions if include_subagents else sessions.where(~F.col("is_subagent"))
    return sessions if include_archived or "is_archived" not in sessions.columns else sessions.where(~F.col("is_archived"))


def export_totals(outcomes: DataFrame) -> DataFrame:
    """Per source: discovered and each outcome (exported, failed, skipped_by_filter, skipped_by_repository)."""
    names = ("exported", "failed", "skipped_by_filter", "skipped_by_repository")
    return outcomes.groupBy("source").agg(F.count("*").alias("discovered"), *[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def manifest_sessions(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """Per session: entry_count, sorted roles, whether an assistant said something, and code points."""
    said = (F.col("role") == "assistant") & (F.trim("body") != "")
    counts = entries.groupBy("session_id").agg(
        F.count("*").alias("entry_count"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"),
        F.bool_or(said).alias("assistant_text_available"), F.sum(F.length("body")).alias("char_count"),
    )
    return sessions.join(counts, "session_id")
