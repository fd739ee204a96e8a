"""Reports on duplication, fork families, people and roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_totals(sessions: DataFrame, entries: DataFrame, skipped: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row of counts, logical, unique and saved bytes and their ratio."""
    counts = sessions.agg(F.count("*").alias("sessions")).join(entries.agg(F.count("*").alias("entries"))).join(skipped.agg(F.count("*").alias("skipped")))
    logical, unique = F.sum(F.col("nbytes") * F.col("nrefs")), F.sum("nbytes")
    sizes = blobs.agg(
        F.count("*").alias("blobs"), F.coalesce(logical, F.lit(0)).alias("logical_bytes"), F.coalesce(unique, F.lit(0)).alias("unique_bytes")
    )
    saved = F.col("logical_bytes") - F.col("unique_bytes")
    ratio = F.when(F.col("logical_bytes") > 0, saved / F.col("logical_bytes")).otherwise(F.lit(0.0))
    return counts.join(sizes).withColumn("saved_bytes", saved).withColumn("saved_ratio", ratio)  # one row each


def top_duplicated_bodies(blobs: DataFrame, n: int = 15) -> DataFrame:
    saved = (F.col("nbytes") * (F.col("nrefs") - 1)).alias("saved_bytes")
    return blobs.where("nrefs >= 2").select("blob_hash", "nbytes", "nrefs", saved).orderBy(F.desc("saved_bytes"), "blob_hash").limit(n)


def fork_families(sessions: DataFrame, entries: DataFrame, first: int = 5, n: int = 10) -> DataFrame:
    """The largest families of primary sessions that begin with the same ``first`` entries, with sizes and people."""
    pairs = entries.where(F.col("seq") < first).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "blob_hash"))).alias("head"))
    heads = pairs.where(F.size("head") == first).select("session_id", F.sha2(F.array_join(F.transform("head", lambda x: x["blob_hash"]), ","), 256).alias("signature"))
    own = heads.join(sessions.where(~F.col("is_subagent")).select("session_id", "person"), "session_id")
    families = own.groupBy("signature").agg(F.count("*").alias("size"), F.count_distinct("person").alias("people"), F.min("session_id").alias("first_session"))
    return families.where("size >= 2").orderBy(F.desc("size"), "signature").limit(n)


def per_person(sessions: DataFrame) -> DataFrame:
    """sessions needs char_count."""
    return sessions.groupBy("person").agg(F.count("*").alias("sessions"), F.count_if("is_subagent").alias("subagents"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"))


def role_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("role").agg(F.count("*").alias("entries"))
