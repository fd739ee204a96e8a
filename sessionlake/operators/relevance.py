"""Session-level relevance search over normalised messages (session_id, idx, role, text), and listings of sessions and prompts.

Terms are substrings in smart case and need to occur somewhere in a session, unlike the corpus search, which wants them in one body.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions import text as T


def prefilter_files(lines: DataFrame, terms: list[str]) -> DataFrame:
    """file_path, matching_lines (over all terms) and bytes of the files that hold every term; a superset of the sessions that match."""
    flags = [F.count_if(T.contains_term(F.col("line"), t)).alias(f"t{i}") for i, t in enumerate(terms)]
    counted = lines.groupBy("file_path").agg(*flags, F.sum(F.octet_length("line") + 1).alias("bytes"))
    every = reduce(Column.__and__, [F.col(f"t{i}") > 0 for i in range(len(terms))], F.lit(bool(terms)))
    total = reduce(Column.__add__, [F.col(f"t{i}") for i in range(len(terms))], F.lit(0))
    return counted.where(every).select("file_path", total.alias("matching_lines"), "bytes")


def order_by_density(files: DataFrame, limit: int = 300) -> DataFrame:
    return files.withColumn("density", F.col("matching_lines") / F.greatest("bytes", F.lit(1))).orderBy(F.desc("density"), "file_path").limit(limit)


def score_sessions(messages: DataFrame, terms: list[str]) -> DataFrame:
    """session_id, coverage (terms found anywhere), match_count (messages with any) and total_messages, of sessions with a match."""
    found = [F.max(T.contains_term(F.col("text"), t).cast("int")) for t in terms]
    scores = messages.groupBy("session_id").agg(
        reduce(Column.__add__, found).alias("coverage"), F.count_if(T.matches_any(F.col("text"), terms)).alias("match_count"), F.count("*").alias("total_messages")
    )
    return scores.where("match_count > 0")


def require_all_terms(scores: DataFrame, terms: list[str]) -> DataFrame:
    return scores.where(F.col("coverage") == len(terms))


def rank_conversations(scores: DataFrame, limit: int, by_density: bool = False) -> DataFrame:
    """The best sessions by coverage, matches (or their density) and recency (sort_ts)."""
    second = T.match_density(F.col("match_count"), F.col("total_messages")) if by_density else F.col("match_count")
    return scores.orderBy(F.desc("coverage"), F.desc(second), F.desc("sort_ts"), "session_id").limit(limit)


def context_groups(messages: DataFrame, terms: list[str], around: int) -> DataFrame:
    """The messages within ``around`` of a match, with is_match and group_id: runs of messages that follow one another."""
    order = Window.partitionBy("session_id").orderBy("idx")
    flagged = messages.withColumn("is_match", T.matches_any(F.col("text"), terms))
    near = F.max(F.col("is_match").cast("int")).over(order.rangeBetween(-around, around))
    kept = flagged.withColumn("near", near).where("near = 1").drop("near")
    gap = F.coalesce(F.col("idx") - F.lag("idx").over(order) > 1, F.lit(True))
    return kept.withColumn("gap", gap.cast("int")).withColumn("group_id", F.sum("gap").over(order)).drop("gap")


def best_copy(conversations: DataFrame) -> DataFrame:
    """One conversation per uuid (the part before ``/``): most matches, then most messages, then the first seen."""
    key = F.substring_index("uuid", "/", 1)
    order = Window.partitionBy(key).orderBy(F.desc("match_count"), F.desc("total_messages"), "seen")
    return conversations.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def scope_sessions(sessions: DataFrame, cwd: str | None = None, project: str | None = None, fall_back: bool = False) -> DataFrame:
    """Sessions of a project (a part of the path in any case) or at or below a directory; ``fall_back``: all if none is."""
    if project:
        inside = F.coalesce(F.contains(F.lower("cwd"), F.lit(project.lower())), F.lit(False))
    elif cwd:
        inside = T.path_under(F.col("cwd"), F.lit(cwd))
    else:
        return sessions
    if not fall_back:
        return sessions.where(inside)
    some = sessions.agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("some_inside"))  # one row
    return sessions.join(F.broadcast(some)).where(inside | ~F.col("some_inside")).drop("some_inside")


#: Fixed value: what stands for the rest of a conversation that is cut, with eight characters of its id.
MORE_LINES = "  [... more matches in this conversation — run: session 12345678]"


def budget_blocks(lines: DataFrame, max_chars: int = 80_000, least: int = 8_000, before: int = 0) -> DataFrame:
    """lines (rank, line_no, text and, if there, header) with kept and cut_reason.

    Each conversation gets max(least, max_chars // n) characters; its header lines always stay and count, its other lines stay up to the first that would
    exceed them. Conversations are taken whole, by rank, until one makes the total (with ``before`` characters, headers and the marks of cuts)
    exceed ``max_chars``: that one still stays, those after it don't.
    """
    header = F.coalesce("header", F.lit(False)) if "header" in lines.columns else F.lit(False)
    n = lines.agg(F.count_distinct("rank").alias("n"))  # one row
    head, said = F.when(header, F.length("text")).otherwise(0), F.when(header, 0).otherwise(F.length("text"))
    whole = Window.partitionBy("rank")
    own = whole.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    share = F.greatest(F.lit(least), F.floor(F.lit(max_chars) / F.greatest("n", F.lit(1))))
    within = lines.join(F.broadcast(n)).withColumn("fits", header | (F.sum(head).over(whole) + F.sum(said).over(own) <= share))
    taken = within.groupBy("rank").agg(F.sum(F.when(F.col("fits"), F.length("text")).otherwise(0)).alias("chars"), F.bool_and("fits").alias("uncut"))
    used = F.col("chars") + F.when(F.col("uncut"), 0).otherwise(len(MORE_LINES))
    earlier = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # one row for each ranked conversation
    offsets = taken.select("rank", (F.coalesce(F.sum(used).over(earlier), F.lit(0)) + before).alias("offset"))
    reason = F.when(F.col("offset") > max_chars, "total_budget").when(~F.col("fits"), "conversation_budget")
    out = within.join(offsets, "rank").withColumn("cut_reason", reason)
    return out.withColumn("kept", F.col("cut_reason").isNull()).drop("fits", "n", "offset")


def recent_sessions(sessions: DataFrame, messages: DataFrame, n: int) -> DataFrame:
    """The newest sessions by sort_ts with their message count and the start of the first thing that the user said."""
    newest = sessions.orderBy(F.desc("sort_ts"), "session_id").limit(n)
    said = messages.join(newest.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.min_by(F.col("text"), F.when(F.col("role") == "user", F.col("idx"))).alias("first"),
    )
    first = F.left(F.regexp_replace("first", "[\r\n]+", " "), F.lit(100))
    return newest.join(said, "session_id", "left").withColumn("first_user_text", first).drop("first")


def project_counts(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("source", F.coalesce("cwd", F.lit("(unknown)")).alias("project")).agg(F.count("*").alias("sessions"))


def search_prompts(prompts: DataFrame, terms: list[str], project: str | None = None, n: int = 30) -> DataFrame:
    """The newest prompts (source, ts, session, project, prompt) with all terms; those of one session by seq, if there is one."""
    found = prompts.where(T.matches_all(F.col("prompt"), terms)) if terms else prompts
    if project:
        found = found.where(F.contains(F.lower("project"), F.lit(project.lower())))
    return found.orderBy(F.desc("ts"), "session", *[c for c in found.columns if c == "seq"]).limit(n)


def list_imports(markers: DataFrame, sessions: DataFrame, project: str | None = None, n: int = 50) -> DataFrame:
    """The newest import markers (thread_id, source_path, imported_at) with the cwd of their session."""
    found = markers.join(sessions.select(F.col("session_id").alias("thread_id"), "cwd"), "thread_id", "left")
    if project:
        found = found.where(F.contains(F.lower("cwd"), F.lit(project.lower())))
    return found.orderBy(F.desc("imported_at"), "thread_id").limit(n)


#: Where one chat is stored in several places, the place that is trusted most comes first.
BACKENDS = ("store_db", "jsonl", "state_kv")


def choose_backend(targets: DataFrame) -> DataFrame:
    """One row per chat_id: that of the preferred backend."""
    order = Window.partitionBy("chat_id").orderBy(F.array_position(F.array(*map(F.lit, BACKENDS)), F.col("backend")), "path")
    return targets.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def find_by_prefix(sessions: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(the session of the preferred backend, ambiguous ids): sessions (chat_id, backend, path) whose id begins so in any case."""
    found = sessions.where(F.startswith(F.lower("chat_id"), F.lit(prefix.lower())))
    ids = found.select("chat_id").distinct().orderBy("chat_id").limit(10)
    several = ids.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))  # 10 rows at most
    one = choose_backend(found).join(F.broadcast(several.where("n = 1").select("chat_id")), "chat_id", "left_semi")
    return one, several.where("n > 1").select("chat_id")
