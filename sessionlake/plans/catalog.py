"""Registered queries over the session corpus and their DuckDB SQL; the corpus is derived from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.operators import exchange, ingest, relevance, reports, requests, search
from sessionlake.plans.corpus_tables import tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, forks: bool = False, plain: bool = False):
    """Register a function of (tables) or, with ``plain``, of (spark, sf_dir)."""

    def add(f):
        QUERIES[name] = f if plain else lambda spark, sf_dir: f(tables(spark, sf_dir, forks))
        if sql:
            ORACLE_SQL[name] = sql if plain else with_tables(sql, forks)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bodies(t: dict[str, DataFrame]) -> DataFrame:
    return t["entries"].groupBy("blob_hash").agg(F.first("body").alias("body"))


def _flat_hits(found: DataFrame) -> DataFrame:
    return found.select("session_id", "hit_count", F.explode("hits").alias("h")).select(
        "session_id", "hit_count", "h.hit_rank", "h.seq", "h.role", F.length("h.body").cast("long").alias("body_chars"), F.sha2("h.body", 256).alias("body_sha")
    )


_TOKENS = "regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')"
_HITS = """
, w AS (SELECT session_id, seq, role, body, {tokens} AS t FROM entries),
h AS (SELECT w.session_id, w.seq, w.role, w.body, s.started_at, s.person, s.repository, s.source FROM w JOIN sessions s USING (session_id)
  WHERE {match} AND NOT is_subagent AND role IN ('user', 'assistant') {more}),
r AS (SELECT session_id, count(*) AS hit_count, max(started_at) AS started_at FROM h GROUP BY session_id ORDER BY 2 DESC, 3 DESC, 1 LIMIT {limit}),
n AS (SELECT h.session_id, hit_count, row_number() OVER (PARTITION BY h.session_id ORDER BY seq) AS hit_rank, seq, role,
  CASE WHEN length(body) <= 4000 THEN body ELSE substr(body, 1, 4000) || chr(10) || '…[truncated]' END AS body FROM h JOIN r USING (session_id))
SELECT session_id, hit_count, hit_rank, seq, role, length(body) AS body_chars, sha256(body) AS body_sha FROM n WHERE hit_rank <= 5"""


def _search_sql(match: str, more: str = "", limit: int = 10) -> str:
    sql = with_tables(_HITS.format(tokens=_TOKENS, match=match, more=more, limit=limit))
    return sql


def _searching(query: str, **options):
    def run(t: dict[str, DataFrame]) -> DataFrame:
        bodies = _bodies(t)
        found = search.search(ingest.build_postings(bodies), t["entries"], t["sessions"], bodies, query, **options)
        return _flat_hits(found)

    return run


QUERIES["search_simple"] = lambda spark, sf_dir: _searching("tion ther")(tables(spark, sf_dir))
ORACLE_SQL["search_simple"] = _search_sql("list_contains(t, 'tion') AND list_contains(t, 'ther')")
QUERIES["search_filtered"] = lambda spark, sf_dir: _searching("tion", person="person1", source="codex", since="2026-03-01", limit=5)(tables(spark, sf_dir))
ORACLE_SQL["search_filtered"] = _search_sql("list_contains(t, 'tion')", "AND person = 'person1' AND source = 'codex' AND started_at >= '2026-03-01'", 5)
QUERIES["search_phrase"] = lambda spark, sf_dir: _searching("'that with'")(tables(spark, sf_dir))
ORACLE_SQL["search_phrase"] = _search_sql("contains(' ' || array_to_string(t, ' ') || ' ', ' that with ')")


@register("search_porter")
def _(t):
    bodies = _bodies(t)
    postings = ingest.build_postings(bodies, "porter")
    return postings.groupBy("term").agg(F.count("*").alias("bodies"), F.sum(F.size("positions")).alias("places"))


@register(
    "postings",
    f", b AS (SELECT DISTINCT blob_hash, body FROM entries), p AS (SELECT blob_hash, unnest({_TOKENS}) AS term FROM b) "
    "SELECT term, count(DISTINCT blob_hash) AS bodies, count(*) AS places FROM p GROUP BY term",
)
def _(t):
    postings = ingest.build_postings(_bodies(t))
    return postings.groupBy("term").agg(F.count("*").alias("bodies"), F.sum(F.size("positions")).alias("places"))


@register("browse_recent", "SELECT session_id, person, repository, started_at FROM sessions WHERE person = 'person2' AND NOT is_subagent ORDER BY started_at DESC, session_id LIMIT 20")
def _(t):
    return search.browse(t["sessions"], person="person2").select("session_id", "person", "repository", "started_at")


@register(
    "read_entries_budget",
    """, m AS (SELECT seq, role, body, row_number() OVER (ORDER BY seq) AS n FROM entries WHERE session_id = 1000002),
    p AS (SELECT *, sum(length(body)) OVER (ORDER BY seq) AS total FROM m WHERE n BETWEEN 2 AND 51)
    SELECT seq, role, length(body) AS chars FROM p WHERE total <= 9000""",
)
def _(t):
    return search.read_entries(t["entries"], None, 1000002, offset=1, max_chars=9000).select("seq", "role", F.length("body").cast("long").alias("chars"))


@register(
    "resolve_session",
    """, c AS (SELECT session_id, uuid, CASE WHEN uuid = '4' THEN 0 WHEN NOT is_subagent THEN 1 ELSE 2 END AS tier FROM sessions WHERE starts_with(uuid, '4'))
    SELECT session_id, uuid FROM c WHERE tier = (SELECT min(tier) FROM c)""",
)
def _(t):
    return search.resolve_candidates(t["sessions"], uuid="4").select("session_id", "uuid")


@register(
    "coverage",
    "SELECT person, repository, count(*) AS sessions, count(*) FILTER (is_subagent) AS subagents, min(started_at) AS first_started, max(started_at) AS last_started FROM sessions GROUP BY person, repository",
)
def _(t):
    return search.coverage(t["sessions"])


@register("storage_totals", "SELECT count(*) AS blobs, sum(nbytes)::BIGINT AS unique_bytes, sum(nbytes * nrefs)::BIGINT AS logical_bytes FROM blobs")
def _(t):
    return search.storage_totals(t["blobs"])


@register(
    "dedup_totals",
    """SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM entries) AS entries, (SELECT count(*) FROM sessions WHERE is_subagent) AS skipped,
    count(*) AS blobs, sum(nbytes * nrefs)::BIGINT AS logical_bytes, sum(nbytes)::BIGINT AS unique_bytes, sum(nbytes * (nrefs - 1))::BIGINT AS saved_bytes,
    round(sum(nbytes * (nrefs - 1)) / sum(nbytes * nrefs), 6) AS saved_ratio FROM blobs""",
    forks=True,
)
def _(t):
    out = reports.dedup_totals(t["sessions"], t["entries"], t["sessions"].where("is_subagent"), t["blobs"])
    return out.withColumn("saved_ratio", F.round("saved_ratio", 6))


@register(
    "top_duplicated_bodies",
    "SELECT blob_hash, nbytes, nrefs, nbytes * (nrefs - 1) AS saved_bytes FROM blobs WHERE nrefs >= 2 ORDER BY 4 DESC, blob_hash LIMIT 15",
    forks=True,
)
def _(t):
    return reports.top_duplicated_bodies(t["blobs"])


@register(
    "fork_families",
    """, p AS (SELECT session_id, count(*) AS n, string_agg(blob_hash, ',' ORDER BY seq) AS head FROM entries WHERE seq < 5 GROUP BY session_id),
    f AS (SELECT sha256(head) AS signature, person, session_id FROM p JOIN sessions USING (session_id) WHERE n = 5 AND NOT is_subagent)
    SELECT signature, count(*) AS size, count(DISTINCT person) AS people, min(session_id) AS first_session FROM f GROUP BY signature HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10""",
    forks=True,
)
def _(t):
    return reports.fork_families(t["sessions"], t["entries"])


_CHARS = ", c AS (SELECT session_id, sum(length(body))::BIGINT AS char_count FROM entries GROUP BY session_id)"


@register(
    "per_person",
    f"{_CHARS} SELECT person, count(*) AS sessions, count(*) FILTER (is_subagent) AS subagents, sum(char_count)::BIGINT AS chars FROM sessions JOIN c USING (session_id) GROUP BY person",
)
def _(t):
    chars = t["entries"].groupBy("session_id").agg(F.sum(F.length("body")).alias("char_count"))
    return reports.per_person(t["sessions"].join(chars, "session_id"))


@register("role_counts", "SELECT role, count(*) AS entries FROM entries GROUP BY role")
def _(t):
    return reports.role_counts(t["entries"])


# Exchange.


def _with_prints(t):
    return t["sessions"].withColumn("session_fingerprint", F.sha2(F.concat_ws("|", "uuid", "started_at"), 256))


_PRINTS = ", f AS (SELECT *, sha256(uuid || '|' || started_at) AS session_fingerprint FROM sessions)"


@register("missing_sessions", f"{_PRINTS} SELECT session_fingerprint AS fingerprint FROM f WHERE person <> 'person1' OR session_id % 2 = 0")
def _(t):
    f = _with_prints(t)
    return exchange.missing_sessions(f.select(F.col("session_fingerprint").alias("fingerprint")), f.where("session_id % 2 = 1"), "person1")


@register("missing_bodies", "SELECT DISTINCT blob_hash FROM entries EXCEPT SELECT blob_hash FROM entries WHERE session_id % 3 = 0")
def _(t):
    return exchange.missing_bodies(t["entries"].select("blob_hash").distinct(), t["entries"].where("session_id % 3 = 0").select("blob_hash"))


@register(
    "plan_delta",
    f"""{_PRINTS}, n AS (SELECT session_id FROM f WHERE NOT (person = 'person1' AND session_id % 2 = 1)),
    need AS (SELECT DISTINCT blob_hash FROM entries WHERE session_id IN (SELECT session_id FROM n)),
    send AS (SELECT nbytes FROM blobs WHERE blob_hash IN (SELECT blob_hash FROM need) AND blob_hash NOT IN (SELECT blob_hash FROM entries WHERE session_id % 2 = 1)),
    x AS (SELECT (SELECT count(*) FROM n) AS n_sessions, (SELECT count(*) FROM send) AS n_bodies, (SELECT coalesce(sum(nbytes), 0)::BIGINT FROM send) AS delta_bytes,
      (SELECT sum(nbytes)::BIGINT FROM blobs) AS whole_bytes, (SELECT count(*) FROM f) AS n)
    SELECT n_sessions, n_bodies, delta_bytes, whole_bytes, CASE WHEN n_sessions = 0 THEN 'empty' WHEN n_sessions = n OR delta_bytes >= 0.8 * whole_bytes THEN 'whole' ELSE 'delta' END AS mode FROM x""",
)
def _(t):
    f, bodies = _with_prints(t), _bodies(t)
    stored = t["entries"].where("session_id % 2 = 1").select("blob_hash")
    return exchange.plan_delta(f, t["entries"], bodies, f.where("session_id % 2 = 1"), stored, "person1")


@register(
    "scope_summary",
    """SELECT string_agg(DISTINCT repository, ',' ORDER BY repository) AS repositories, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS sessions,
    count(*) FILTER (session_id % 4 = 0) AS side_chats, count(*) FILTER (session_id % 8 = 0) AS incomplete_side_chats FROM sessions""",
)
def _(t):
    s = t["sessions"].withColumn("backend", F.when(F.col("session_id") % 4 == 0, "side_chat")).withColumn("ended_at", F.when(F.col("session_id") % 8 != 0, F.col("ended_at")))
    return exchange.scope_summary(s)


@register(
    "validate_scope",
    """SELECT 'session_count' AS violation UNION ALL SELECT 'repository:github.com/acme/r3' UNION ALL SELECT 'repository:github.com/acme/none'
    UNION ALL SELECT DISTINCT 'before_since' FROM sessions WHERE ended_at < '2026-02-01' UNION ALL SELECT DISTINCT 'after_until' FROM sessions WHERE started_at > '2026-08-01'""",
)
def _(t):
    scope = exchange.Scope(tuple(f"github.com/acme/{r}" for r in ("r0", "r1", "r2", "none")), ("claude", "codex", "cursor"), 1, "2026-02-01", "2026-08-01")
    return exchange.validate_scope(_with_prints(t), scope)


@register(
    "filter_export",
    "SELECT session_id, started_at FROM sessions WHERE contains(cwd, '/r1') AND ended_at >= '2026-03-01' AND started_at <= '2026-07-01' AND repository IN ('github.com/acme/r1') AND NOT is_subagent",
)
def _(t):
    kept = exchange.filter_export(t["sessions"], "/R1", "2026-03-01", "2026-07-01", ["GitHub.com/acme/r1"], include_subagents=False)
    return kept.select("session_id", "started_at")


@register(
    "export_totals",
    """SELECT source, count(*) AS discovered, count(*) FILTER (session_id % 4 = 0) AS exported, count(*) FILTER (session_id % 4 = 1) AS failed,
    count(*) FILTER (session_id % 4 = 2) AS skipped_by_filter, count(*) FILTER (session_id % 4 = 3) AS skipped_by_repository FROM sessions GROUP BY source""",
)
def _(t):
    names = F.array(*map(F.lit, ("exported", "failed", "skipped_by_filter", "skipped_by_repository")))
    return exchange.export_totals(t["sessions"].withColumn("outcome", F.element_at(names, (F.col("session_id") % 4 + 1).cast("int"))))


@register(
    "manifest_sessions",
    """SELECT session_id, count(*) AS entry_count, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, bool_or(role = 'assistant' AND trim(body) <> '') AS assistant_text_available,
    sum(length(body))::BIGINT AS char_count FROM entries GROUP BY session_id""",
)
def _(t):
    return exchange.manifest_sessions(t["sessions"], t["entries"]).select("session_id", "entry_count", "roles", "assistant_text_available", "char_count")


# Ingest.


def _generations(t):
    """Every session, and every third again with a later, an equal or no end."""
    base = t["sessions"].select("session_id", "person", "source", "ended_at", F.col("uuid").alias("session_key"), (F.col("session_id") % 7).cast("int").alias("entry_count"))
    again = base.where("session_id % 3 = 0").withColumn("ended_at", F.when(F.col("session_id") % 9 == 0, F.lit(None).cast("string")).when(F.col("session_id") % 2 == 0, F.lit("2026-12-01T00:00:00Z")).otherwise(F.col("ended_at")))
    again = again.withColumn("entry_count", F.col("entry_count") + (F.col("session_id") % 2).cast("int"))
    return base.withColumn("arrival", F.lit(0)).unionByName(again.withColumn("arrival", F.lit(1)))


@register(
    "latest_generation",
    """, g AS (SELECT session_id, person, source, uuid, ended_at, session_id % 7 AS entry_count, 0 AS arrival FROM sessions
      UNION ALL SELECT session_id, person, source, uuid, CASE WHEN session_id % 9 = 0 THEN NULL WHEN session_id % 2 = 0 THEN '2026-12-01T00:00:00Z' ELSE ended_at END, session_id % 7 + session_id % 2, 1 FROM sessions WHERE session_id % 3 = 0)
    SELECT session_id, arrival, ended_at FROM g QUALIFY row_number() OVER (PARTITION BY person, source, uuid ORDER BY ended_at DESC NULLS LAST, entry_count DESC, arrival) = 1""",
)
def _(t):
    return ingest.latest_generation(_generations(t))[0].select("session_id", "arrival", "ended_at")


@register(
    "split_duplicate_content",
    """, f AS (SELECT session_id, person, md5(CAST(session_id % 50 AS VARCHAR)) AS p, session_id AS arrival FROM sessions),
    n AS (SELECT *, row_number() OVER (PARTITION BY person, p ORDER BY arrival) AS nth FROM f WHERE session_id % 4 <> 0)
    SELECT session_id FROM n WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.session_id % 4 = 0 AND f.person = n.person AND f.p = n.p)""",
)
def _(t):
    f = t["sessions"].select("session_id", "person", F.md5((F.col("session_id") % 50).cast("string")).alias("session_fingerprint"), F.col("session_id").alias("arrival"))
    return ingest.split_duplicate_content(f.where("session_id % 4 <> 0"), f.where("session_id % 4 = 0"))[0].select("session_id")


@register(
    "filter_allowed_repositories",
    "SELECT session_id, CASE WHEN repository IN ('github.com/acme/r1', 'github.com/acme/r2') THEN 'ok' ELSE 'repository_not_allowed' END AS reason FROM sessions",
)
def _(t):
    allow = t["sessions"].sparkSession.createDataFrame([("GitHub.com/acme/R1",), ("github.com/acme/r2",)], "repository string")
    kept, rejected = ingest.filter_allowed_repositories(t["sessions"], allow)
    return kept.select("session_id", F.lit("ok").alias("reason")).unionByName(rejected.select("session_id", "reason"))


@register("split_missing_entries", "SELECT session_id FROM sessions WHERE session_id NOT IN (SELECT session_id FROM entries WHERE role = 'system')")
def _(t):
    return ingest.split_missing_entries(t["sessions"], t["entries"].where("role = 'system'"))[1].select("session_id")


@register(
    "validate_entry_maps",
    """SELECT DISTINCT session_id, 'bad_body_hash' AS violation FROM entries WHERE seq = 6 UNION ALL SELECT DISTINCT session_id, 'sequence_not_increasing' FROM entries WHERE seq = 5""",
)
def _(t):
    e = t["entries"].select(
        "session_id", F.col("seq").alias("file_pos"), F.when(F.col("seq") == 5, 4).otherwise(F.col("seq")).alias("seq"), "role",
        F.lit("### x").alias("header_line"), F.when(F.col("seq") == 6, "short").otherwise(F.col("blob_hash")).alias("body_sha256"),
    )
    return ingest.validate_entry_maps(e)


@register("verify_bodies", "SELECT DISTINCT blob_hash, 'body_hash_mismatch' AS violation FROM entries WHERE seq = 7 AND body <> ''")
def _(t):
    e = t["entries"].where("body <> ''").select("blob_hash", F.when(F.col("seq") == 7, F.concat("body", F.lit("x"))).otherwise(F.col("body")).alias("body")).distinct()
    return ingest.verify_bodies(e)


@register("content_address", "SELECT blob_hash, nbytes FROM blobs")
def _(t):
    return ingest.content_address(t["entries"].drop("blob_hash"))[1].select("blob_hash", "nbytes")


@register("recount_references", "SELECT b.blob_hash, nbytes, count(e.blob_hash) AS nrefs FROM blobs b LEFT JOIN (SELECT blob_hash FROM entries WHERE session_id % 2 = 0) e USING (blob_hash) GROUP BY ALL")
def _(t):
    return ingest.recount_references(t["blobs"], t["entries"].where("session_id % 2 = 0"))


@register(
    "reuse_counts",
    """, k AS (SELECT DISTINCT blob_hash FROM entries WHERE session_id % 5 = 0),
    m AS (SELECT body, k.blob_hash IS NULL AND row_number() OVER (PARTITION BY e.blob_hash ORDER BY session_id, seq) = 1 AS new FROM (SELECT * FROM entries WHERE session_id % 5 <> 0) e LEFT JOIN k USING (blob_hash))
    SELECT count(*) FILTER (new) AS created, count(*) FILTER (NOT new) AS reused, coalesce(sum(strlen(body)) FILTER (NOT new), 0)::BIGINT AS bytes_saved FROM m""",
    forks=True,
)
def _(t):
    return ingest.reuse_counts(t["entries"].where("session_id % 5 <> 0"), t["entries"].where("session_id % 5 = 0").select("blob_hash"))


@register("skip_reason_counts", "SELECT CASE session_id % 3 WHEN 0 THEN 'repository_not_allowed' WHEN 1 THEN 'stale_session_generation' ELSE 'duplicate_session_content' END AS reason, count(*) AS n FROM sessions GROUP BY 1")
def _(t):
    return ingest.skip_reason_counts(t["sessions"].select(F.expr("CASE session_id % 3 WHEN 0 THEN 'repository_not_allowed' WHEN 1 THEN 'stale_session_generation' ELSE 'duplicate_session_content' END").alias("reason")))


@register(
    "session_key",
    """SELECT session_id, sha256('{"fallback":"f' || session_id || '","source":"' || source || '","started_at":' || CASE WHEN session_id % 2 = 0 THEN 'null' ELSE '"' || started_at || '"' END || ',"uuid":"' || uuid || '"}') AS session_key FROM sessions""",
)
def _(t):
    started = F.when(F.col("session_id") % 2 != 0, F.col("started_at"))
    key = T.session_key(F.col("source"), F.col("uuid"), started, F.concat(F.lit("f"), F.col("session_id").cast("string")))
    return t["sessions"].select("session_id", key.alias("session_key"))


@register(
    "session_fingerprint",
    """, j AS (SELECT session_id, string_agg('{"body_sha256":"' || blob_hash || '","header_line":"### [' || seq || ']","role":"' || role || '","seq":' || seq || ',"ts":null}', ',' ORDER BY seq) AS js FROM entries GROUP BY session_id)
    SELECT session_id, sha256('{"entries":[' || js || '],"source":"' || source || '","uuid":"' || uuid || '"}') AS fingerprint FROM sessions JOIN j USING (session_id)""",
)
def _(t):
    e = t["entries"].select("session_id", "seq", "role", F.col("blob_hash").alias("body_sha256"), F.concat(F.lit("### ["), F.col("seq").cast("string"), F.lit("]")).alias("header_line"), F.lit(None).cast("string").alias("ts"))
    return ingest.session_fingerprints(t["sessions"], e)


@register(
    "backfill_session_keys",
    """, k AS (SELECT session_id, person, source, ended_at, sha256('{"fallback":"f' || session_id % 20 || '","source":"' || source || '","started_at":"t","uuid":"u"}') AS session_key FROM sessions)
    SELECT session_id, session_key FROM k QUALIFY row_number() OVER (PARTITION BY person, source, session_key ORDER BY ended_at DESC, session_id DESC) = 1""",
)
def _(t):
    s = t["sessions"].select(
        "session_id", "person", "source", F.lit("u").alias("uuid"), F.lit("t").alias("started_at"), "ended_at", F.lit(1).alias("entry_count"),
        F.lit(None).cast("string").alias("session_key"),
        F.concat(F.lit("a/f"), (F.col("session_id") % 20).cast("string"), F.lit("__unknown-time__x.entries.json")).alias("export_path"),
    )
    return ingest.backfill_session_keys(s).select("session_id", "session_key")


@register(
    "import_ledger",
    """SELECT 'person1' AS person, 'abc' AS archive_sha256, 'first' AS imported_at, count(*) FILTER (person = 'person1' AND session_id % 2 = 0) AS sessions_kept, count(*) FILTER (person <> 'person1' OR session_id % 2 = 1) AS sessions_skipped FROM sessions
    UNION ALL SELECT 'person1', 'other', 'second', 3, 4 UNION ALL SELECT 'person2', 'abc', 'third', 5, 6""",
)
def _(t):
    """One bundle's row renewed in a ledger of three: half of its person's sessions are still live."""
    f = _with_prints(t)
    rows = [("person1", "abc", "first", 1, 2), ("person1", "other", "second", 3, 4), ("person2", "abc", "third", 5, 6)]
    return ingest.import_ledger(f.sparkSession.createDataFrame(rows, ingest.IMPORTS), "person1", "abc", f, f.where("session_id % 2 = 0"), "first")


# Relevance.


def _messages(t):
    return t["entries"].select("session_id", F.col("seq").alias("idx"), "role", F.col("body").alias("text"))


_TERMS = ["tion", "The"]
_ANY = "(contains(lower(body), 'tion') OR contains(body, 'The'))"


@register(
    "score_sessions",
    f"""SELECT session_id, max(contains(lower(body), 'tion')::INT) + max(contains(body, 'The')::INT) AS coverage, count(*) FILTER ({_ANY}) AS match_count, count(*) AS total_messages
    FROM entries GROUP BY session_id HAVING count(*) FILTER ({_ANY}) > 0""",
)
def _(t):
    return relevance.score_sessions(_messages(t), _TERMS)


@register(
    "rank_conversations",
    f""", c AS (SELECT session_id, max(contains(lower(body), 'tion')::INT) + max(contains(body, 'The')::INT) AS coverage, count(*) FILTER ({_ANY}) AS match_count, count(*) AS total_messages FROM entries GROUP BY session_id)
    SELECT session_id, coverage, match_count FROM c JOIN sessions USING (session_id) WHERE match_count > 0 AND coverage = 2 ORDER BY coverage DESC, match_count DESC, started_at DESC, session_id LIMIT 25""",
)
def _(t):
    scores = relevance.require_all_terms(relevance.score_sessions(_messages(t), _TERMS), _TERMS)
    joined = scores.join(t["sessions"], "session_id").withColumn("sort_ts", T.sort_ts(F.col("started_at")))
    return relevance.rank_conversations(joined, 25).select("session_id", "coverage", "match_count")


@register(
    "context_groups",
    """, m AS (SELECT session_id, seq AS idx, contains(lower(body), 'thing') AS is_match FROM entries),
    k AS (SELECT *, max(is_match::INT) OVER (PARTITION BY session_id ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM m),
    g AS (SELECT session_id, idx, is_match, coalesce(idx - lag(idx) OVER (PARTITION BY session_id ORDER BY idx) > 1, true)::INT AS gap FROM k WHERE near = 1)
    SELECT session_id, idx, is_match, sum(gap) OVER (PARTITION BY session_id ORDER BY idx)::BIGINT AS group_id FROM g""",
)
def _(t):
    return relevance.context_groups(_messages(t), ["thing"], 1).select("session_id", "idx", "is_match", "group_id")


@register(
    "best_copy",
    """, c AS (SELECT session_id, session_id % 60 AS u, session_id % 4 AS match_count, session_id % 7 AS total_messages FROM sessions)
    SELECT session_id FROM c QUALIFY row_number() OVER (PARTITION BY u ORDER BY match_count DESC, total_messages DESC, session_id) = 1""",
    forks=True,
)
def _(t):
    c = t["sessions"].select(
        "session_id", F.concat_ws("/", (F.col("session_id") % 60).cast("string"), F.col("session_id").cast("string")).alias("uuid"),
        (F.col("session_id") % 4).alias("match_count"), (F.col("session_id") % 7).alias("total_messages"), F.col("session_id").alias("seen"),
    )
    return relevance.best_copy(c).select("session_id")


@register("scope_sessions", "SELECT session_id, cwd FROM sessions WHERE cwd = '/home/p1' OR starts_with(cwd, '/home/p1/')")
def _(t):
    return relevance.scope_sessions(t["sessions"], cwd="/home/p1/", fall_back=True).select("session_id", "cwd")


@register("prefilter_files", """, f AS (SELECT session_id, count(*) FILTER (contains(lower(body), 'thing')) AS a, count(*) FILTER (contains(body, 'Th')) AS b, sum(strlen(body) + 1)::BIGINT AS bytes FROM entries GROUP BY session_id)
    SELECT 'f' || session_id AS file_path, a + b AS matching_lines, bytes FROM f WHERE a > 0 AND b > 0 ORDER BY (a + b) / bytes DESC, file_path LIMIT 300""")
def _(t):
    lines = t["entries"].select(F.concat(F.lit("f"), F.col("session_id").cast("string")).alias("file_path"), F.col("body").alias("line"))
    return relevance.order_by_density(relevance.prefilter_files(lines, ["thing", "Th"])).drop("density")


def _budget_sql(second: str) -> str:
    """Ranked conversations with a header line each and the budget's rules."""
    mark = len(relevance.MORE_LINES)
    return f""", c AS (SELECT session_id, max(contains(lower(body), 'tion')::INT) + max(contains(body, 'The')::INT) AS coverage, count(*) FILTER ({_ANY}) AS match_count, count(*) AS total_messages FROM entries GROUP BY session_id),
    k AS (SELECT session_id, source, row_number() OVER (ORDER BY coverage DESC, {second} DESC, started_at DESC, session_id) AS rank FROM c JOIN sessions USING (session_id) WHERE match_count > 0 ORDER BY rank LIMIT 25),
    l AS (SELECT rank, session_id, seq AS line_no, length(body) AS size, 0 AS head FROM entries JOIN k USING (session_id) UNION ALL SELECT rank, session_id, -1, 0, length('[' || source || '] ' || session_id) FROM k),
    n AS (SELECT greatest(8000, floor(40000 / count(DISTINCT rank))) AS share FROM l),
    f AS (SELECT *, line_no = -1 OR sum(head) OVER (PARTITION BY rank) + sum(size) OVER (PARTITION BY rank ORDER BY line_no) <= share AS fits FROM l, n),
    u AS (SELECT rank, sum(CASE WHEN fits THEN size + head ELSE 0 END) + CASE WHEN bool_and(fits) THEN 0 ELSE {mark} END AS used FROM f GROUP BY rank),
    o AS (SELECT rank, coalesce(sum(used) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 60 AS earlier FROM u)
    SELECT rank, session_id, line_no, CASE WHEN earlier > 40000 THEN 'total_budget' WHEN NOT fits THEN 'conversation_budget' END AS cut_reason FROM f JOIN o USING (rank)"""


def _budgeted(t, by_density: bool):
    from pyspark.sql import Window

    scores = relevance.score_sessions(_messages(t), _TERMS).join(t["sessions"], "session_id").withColumn("sort_ts", T.sort_ts(F.col("started_at")))
    best = relevance.rank_conversations(scores, 25, by_density)  # 25 rows
    second = T.match_density(F.col("match_count"), F.col("total_messages")) if by_density else F.col("match_count")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("coverage"), F.desc(second), F.desc("sort_ts"), "session_id")
    ranks = best.select("session_id", "source", F.row_number().over(order).cast("long").alias("rank"))
    said = t["entries"].join(F.broadcast(ranks), "session_id").select("rank", "session_id", F.col("seq").alias("line_no"), F.col("body").alias("text"), F.lit(False).alias("header"))
    title = F.concat(F.lit("["), "source", F.lit("] "), F.col("session_id").cast("string"))
    heads = ranks.select("rank", "session_id", F.lit(-1).alias("line_no"), title.alias("text"), F.lit(True).alias("header"))
    return relevance.budget_blocks(said.unionByName(heads), 40_000, before=60).select("rank", "session_id", "line_no", "cut_reason")


@register("budget_blocks", _budget_sql("match_count / (total_messages + 10)"))
def _(t):
    return _budgeted(t, by_density=True)


@register("budget_blocks_ranked", _budget_sql("match_count"))
def _(t):
    return _budgeted(t, by_density=False)


@register(
    "recent_sessions",
    """, n AS (SELECT session_id, started_at FROM sessions ORDER BY started_at DESC, session_id LIMIT 15)
    SELECT n.session_id, count(*) AS messages, substr(regexp_replace(arg_min(body, CASE WHEN role = 'user' THEN seq END), '[\\r\\n]+', ' ', 'g'), 1, 100) AS first_user_text
    FROM n JOIN entries USING (session_id) GROUP BY n.session_id""",
)
def _(t):
    s = t["sessions"].withColumn("sort_ts", T.sort_ts(F.col("started_at")))
    return relevance.recent_sessions(s, _messages(t), 15).select("session_id", "messages", "first_user_text")


@register("project_counts", "SELECT source, CASE WHEN session_id % 6 = 0 THEN '(unknown)' ELSE cwd END AS project, count(*) AS sessions FROM sessions GROUP BY ALL")
def _(t):
    return relevance.project_counts(t["sessions"].withColumn("cwd", F.when(F.col("session_id") % 6 != 0, F.col("cwd"))))


@register(
    "search_prompts",
    "SELECT session_id AS session, started_at AS ts, seq FROM entries JOIN sessions USING (session_id) WHERE role = 'user' AND contains(lower(cwd), '/r1') AND contains(lower(body), 'tion') AND contains(body, 'The') ORDER BY started_at DESC, session_id, seq LIMIT 30",
)
def _(t):
    p = t["entries"].where("role = 'user'").join(t["sessions"], "session_id")
    p = p.select(F.col("session_id").alias("session"), F.col("started_at").alias("ts"), "seq", F.col("cwd").alias("project"), F.col("body").alias("prompt"))
    return relevance.search_prompts(p, _TERMS, "/R1").select("session", "ts", "seq")


@register(
    "search_prompts_all",
    "SELECT session_id AS session, started_at AS ts, seq FROM entries JOIN sessions USING (session_id) WHERE role = 'user' AND contains(lower(body), 'tion') AND contains(body, 'The') ORDER BY started_at DESC, session_id, seq LIMIT 30",
)
def _(t):
    p = t["entries"].where("role = 'user'").join(t["sessions"], "session_id")
    p = p.select(F.col("session_id").alias("session"), F.col("started_at").alias("ts"), "seq", F.col("cwd").alias("project"), F.col("body").alias("prompt"))
    return relevance.search_prompts(p, _TERMS).select("session", "ts", "seq")


@register(
    "choose_backend",
    """, c AS (SELECT session_id % 90 AS chat, CASE session_id % 4 WHEN 0 THEN 'state_kv' WHEN 1 THEN 'jsonl' ELSE 'store_db' END AS backend, session_id FROM sessions)
    SELECT CAST(chat AS VARCHAR) AS chat_id, backend FROM c QUALIFY row_number() OVER (PARTITION BY chat ORDER BY list_position(['store_db', 'jsonl', 'state_kv'], backend), CAST(session_id AS VARCHAR)) = 1""",
)
def _(t):
    c = t["sessions"].select((F.col("session_id") % 90).cast("string").alias("chat_id"), F.expr("CASE session_id % 4 WHEN 0 THEN 'state_kv' WHEN 1 THEN 'jsonl' ELSE 'store_db' END").alias("backend"), F.col("session_id").cast("string").alias("path"))
    return relevance.choose_backend(c).select("chat_id", "backend")


@register("find_by_prefix", "SELECT uuid AS chat_id FROM sessions WHERE starts_with(uuid, '5') ORDER BY uuid LIMIT 10")
def _(t):
    c = t["sessions"].select(F.col("uuid").alias("chat_id"), F.lit("jsonl").alias("backend"), F.lit("p").alias("path"))
    one, several = relevance.find_by_prefix(c, "5")
    return one.select("chat_id").unionByName(several)


# Requests and uploads.


@register("list_requests", "SELECT id, actor, status_code FROM requests WHERE mcp_name = 'click' AND id < 900 ORDER BY id DESC LIMIT 50")
def _(t):
    return requests.list_requests(t["requests"], before_id=900, limit=50, mcp_name="click").select("id", "actor", "status_code")


@register(
    "request_counts",
    " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value, count(*) AS n FROM requests GROUP BY 2" for d in requests.DIMENSIONS
    ),
)
def _(t):
    return requests.request_counts(t["requests"])


@register(
    "latency_quantiles",
    """, r AS (SELECT duration_ms, row_number() OVER (ORDER BY duration_ms) AS k, count(*) OVER () AS n FROM requests WHERE duration_ms IS NOT NULL)
    SELECT round(max(duration_ms) FILTER (k = floor((n - 1) * 0.5) + 1), 3) AS p50, round(max(duration_ms) FILTER (k = floor((n - 1) * 0.95) + 1), 3) AS p95, round(max(duration_ms), 3) AS max FROM r""",
)
def _(t):
    return requests.latency_quantiles(t["requests"])


@register("retain_latest", "SELECT id FROM requests ORDER BY id DESC LIMIT 500")
def _(t):
    return requests.retain_latest(t["requests"], 500).select("id")


_JSON = [  # operation, arguments and what is kept of them; @A and @I stand for a request's actor and id
    ("search", '{"query":"find @A","person":"\u00e9@A","limit":@I,"includeSubagents":true,"maxHitsPerSession":"3","roles":["a","b"],"secret":"x"}', None),
    ("browse", '{"person":5,"since":"2026\\n@I","limit":1.5}', '{"since":"2026\\n@I"}'),
    ("read_session", '{"uuid":"' + "u" * 201 + '","sessionId":@I,"maxChars":null,"offset":false}', '{"uuid":"' + "u" * 200 + '","sessionId":@I,"offset":false}'),
    ("prepare_upload", '{"archiveSha256":"s@I","archiveBytes":@I,"scope":{"repositories":["r\u00e9@I"],"since":7,"sessionCount":@I,"notes":"private"}}',
     '{"archiveSha256":"s@I","archiveBytes":@I,"scope":{"repositories":["r\\u00e9@I"],"sources":null,"since":null,"until":null,"sessionCount":@I,"visibility":null}}'),
    ("upload_status", "{}", '{"uploadId":null}'),
    ("list_my_uploads", '{"limit":@I,"x":1}', '{"limit":@I}'),
    ("admin_requests", '{"statusCode":"x\\"@I","name":"@A","limit":null,"other":1}', '{"limit":null,"name":"@A","statusCode":"x\\"@I"}'),
    ("stats", '{"since":"@I"}', '{"since":"@I"}'),
    ("plan_upload", '{"sessionFingerprints":["@I","b"]}', '{"sessionFingerprintCount":2}'),
    ("missing_blobs", '{"blobHashes":{}}', '{"argumentNames":["blobHashes"]}'),
    ("mystery", '{"b":"@I","a\\t\u00e9":2}', '{"argumentNames":["a\\t\\u00e9","b"]}'),
    ("search", '["@I"]', None),
]


def _sql_text(text: str) -> str:
    return "replace(replace('" + text.replace("'", "''") + "', '@A', actor), '@I', CAST(id AS VARCHAR))"


_SEARCHED = "'{\"queryChars\":' || length('find ' || actor) || ',\"querySha256\":\"' || sha256('find ' || actor) || '\",\"person\":\"\\u00e9' || actor || '\",\"includeSubagents\":true,\"limit\":' || id || ',\"roleCount\":2}'"
_REDACTED = " ".join(f"WHEN {i} THEN {_SEARCHED if i == 0 else 'NULL' if kept is None else _sql_text(kept)}" for i, (_, _, kept) in enumerate(_JSON))
_BODIES = ('{"error":{"code":1}}', '{"result":{"isError":true}}', "{}", "not json")


@register(
    "redacted_requests",
    f"""SELECT id, 'given' AS kind, CASE WHEN arguments_json IS NOT NULL THEN '{{"argumentNames":["k"]}}' END AS arguments_json, CASE WHEN status_code < 400 THEN NULL ELSE 'request_failed' END AS error_code FROM requests
    UNION ALL SELECT id, 'made', CASE id % 12 {_REDACTED} END, CASE id % 4 WHEN 0 THEN 'mcp_protocol_error' WHEN 1 THEN 'mcp_tool_error' ELSE CASE WHEN status_code < 400 THEN NULL ELSE 'request_failed' END END FROM requests""",
)
def _(t):
    given = t["requests"].withColumn("response_body", F.lit("{}")).withColumn("kind", F.lit("given"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    i = F.col("id")
    arguments = F.replace(F.replace(pick([a for _, a, _ in _JSON], i % 12), F.lit("@A"), F.col("actor")), F.lit("@I"), i.cast("string"))
    made = given.withColumn("mcp_name", pick([n for n, _, _ in _JSON], i % 12)).withColumn("arguments_json", arguments)
    made = made.withColumn("response_body", pick(_BODIES, i % 4)).withColumn("kind", F.lit("made"))
    return requests.redacted_requests(given.unionByName(made)).select("id", "kind", "arguments_json", "error_code")


def _uploads(t):
    names = ["prepared", "receiving", "uploaded", "queued", "processing", "failed", "complete"]
    status = F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 7 + 1).cast("int"))
    return t["requests"].select(F.col("request_id").alias("upload_id"), F.col("actor").alias("owner"), status.alias("status"), F.col("id").alias("nbytes"), F.col("id").cast("double").alias("updated_at"))


_UP = ", u AS (SELECT request_id AS upload_id, actor AS owner, ['prepared', 'receiving', 'uploaded', 'queued', 'processing', 'failed', 'complete'][id % 7 + 1] AS status, id AS nbytes, CAST(id AS DOUBLE) AS updated_at FROM requests)"


@register("pending_bytes", f"{_UP} SELECT owner, sum(nbytes)::BIGINT AS pending_bytes FROM u WHERE status <> 'complete' AND upload_id <> 'r5' GROUP BY owner HAVING sum(nbytes) > 1000")
def _(t):
    return requests.pending_bytes(_uploads(t), but="r5").where("pending_bytes > 1000")


_STATUSES = ("prepared", "receiving", "uploaded", "queued", "processing", "failed", "complete", "cancelled", "expired")


@register(
    "quota_violations",
    f""", u AS (SELECT request_id AS upload_id, actor AS owner, {list(_STATUSES)}[id % 9 + 1] AS status, id AS nbytes FROM requests),
    p AS (SELECT owner, sum(nbytes)::BIGINT AS held FROM u WHERE status IN ('prepared', 'receiving', 'uploaded', 'queued', 'processing', 'failed') GROUP BY owner),
    a AS (SELECT upload_id, owner, nbytes, status, CASE WHEN status = 'failed' THEN nbytes ELSE 0 END AS own FROM u WHERE status IN ('failed', 'complete', 'cancelled', 'expired')
      UNION ALL SELECT 'new' || upload_id, owner, nbytes, NULL, 0 FROM u)
    SELECT upload_id, owner, (coalesce(held, 0) - own)::BIGINT AS pending_bytes, nbytes AS asked_bytes FROM a LEFT JOIN p USING (owner) WHERE coalesce(held, 0) - own + nbytes > 5000""",
)
def _(t):
    """Every upload, of every status, asked for again, and again under a new id: those under way are allowed."""
    status = F.element_at(F.array(*map(F.lit, _STATUSES)), (F.col("id") % 9 + 1).cast("int"))
    u = _uploads(t).drop("status").join(t["requests"].select(F.col("request_id").alias("upload_id"), status.alias("status")), "upload_id")
    again = u.select("upload_id", "owner", "nbytes")
    return requests.quota_violations(u, again.unionByName(again.withColumn("upload_id", F.concat(F.lit("new"), "upload_id"))), 5000)


@register("request_total", "SELECT count(*) AS request_count FROM requests WHERE started_at >= '2024-01-05'")
def _(t):
    return requests.request_total(t["requests"].withColumn("started_at", F.col("started_at").cast("string")), "2024-01-05")


@register("expire_abandoned", f"{_UP} SELECT count(*) AS expired, sum(nbytes)::BIGINT AS expired_bytes FROM u WHERE status IN ('prepared', 'receiving', 'uploaded', 'failed') AND updated_at < 400 AND upload_id <> 'r8'")
def _(t):
    return requests.expire_abandoned(_uploads(t), 500, 100, ["r8"])[1]


@register("list_uploads", f"{_UP} SELECT upload_id, status FROM u WHERE owner = 'user7' ORDER BY updated_at DESC, upload_id LIMIT 20")
def _(t):
    return requests.list_uploads(_uploads(t), "user7").select("upload_id", "status")


@register(
    "upload_state",
    """SELECT 'u' || id // 7 AS upload_id, arg_min(actor, id) AS owner, CASE max(id % 7) WHEN 0 THEN 'prepared' WHEN 1 THEN 'receiving' WHEN 2 THEN 'uploaded' WHEN 3 THEN 'queued' WHEN 4 THEN 'processing' ELSE 'complete' END AS status,
    min(id) AS nbytes, CAST(max(id) FILTER (id % 7 < 6) AS DOUBLE) AS updated_at, CAST(count(*) FILTER (id % 7 = 6) AS INTEGER) AS rejected FROM requests GROUP BY id // 7""",
)
def _(t):
    order = F.array(*map(F.lit, ("prepare", "receive", "received", "commit", "process", "complete", "cancel")))
    events = t["requests"].select(
        F.concat(F.lit("u"), (F.col("id") / 7).cast("long").cast("string")).alias("upload_id"), F.col("id").alias("event_no"),
        F.element_at(order, (F.col("id") % 7 + 1).cast("int")).alias("event"), F.col("actor").alias("owner"), F.col("id").alias("nbytes"), F.col("id").cast("double").alias("at"),
    )
    return requests.upload_state(events)


@register(
    "assign_people",
    """, p AS (SELECT DISTINCT 'u' || id % 40 || '.' || id % 2 || '@x' || id % 3 || '.org' AS principal, id % 120 AS a FROM requests),
    l AS (SELECT principal, min(a) AS a, replace(split_part(principal, '@', 1), '.', '-') AS label FROM p GROUP BY principal),
    n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY a, principal) AS nth FROM l)
    SELECT principal, CASE WHEN nth = 1 AND label <> 'u3-1' THEN label ELSE label || '-' || substr(sha256(principal), 1, 8) END AS person FROM n""",
)
def _(t):
    text = F.concat(F.lit("U"), (F.col("id") % 40).cast("string"), F.lit("."), (F.col("id") % 2).cast("string"), F.lit("@x"), (F.col("id") % 3).cast("string"), F.lit(".org"))
    known = t["requests"].sparkSession.createDataFrame([("someone@else", "u3-1")], "principal string, person string")
    return requests.assign_people(t["requests"].select(text.alias("principal"), (F.col("id") % 120).alias("arrival")), known)


# Column functions.


@register(
    "strip_noise",
    "SELECT page_id, length(regexp_replace(replace(replace(html, '<title>', '<command-name>'), '</title>', '</command-name>'), '<command-name>.*?</command-name>', '', 'gs')) AS chars FROM pages",
    plain=True,
)
def _(spark, sf_dir):
    html = F.replace(F.replace("html", F.lit("<title>"), F.lit("<command-name>")), F.lit("</title>"), F.lit("</command-name>"))
    return _read(spark, sf_dir, "pages").select("page_id", F.length(T.strip_noise(html)).cast("long").alias("chars"))


@register(
    "repository_slug",
    """WITH u AS (SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^:/?#@]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '\\.git$', '') AS path FROM pages),
    p AS (SELECT page_id, host, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u)
    SELECT page_id, CASE WHEN len(parts) >= 2 THEN lower(host || '/' || array_to_string(parts, '/')) END AS slug FROM p""",
    plain=True,
)
def _(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.repository_slug(F.col("url")).alias("slug"))


@register(
    "text_functions",
    """SELECT doc_id, contains(lower(text), 'thing') AS lower_term, contains(text, 'The') AS exact_term,
    length(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || chr(10) || '…[truncated]' END) AS hit_chars,
    sha256(CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || '... [truncated, ' || length(text) || ' chars total]' END) AS block_sha,
    sha256(regexp_replace(text, 'The|tioN', '>>>\\0<<<', 'g')) AS marked_sha, sha256(text) AS body_sha, round(n_chars / (n_chars + 10), 9) AS density FROM documents""",
    plain=True,
)
def _(spark, sf_dir):
    c = F.col("text")
    return _read(spark, sf_dir, "documents").select(
        "doc_id", T.contains_term(c, "thing").alias("lower_term"), T.contains_term(c, "The").alias("exact_term"),
        F.length(T.truncate_hit(c, 200)).cast("long").alias("hit_chars"), F.sha2(T.truncate_block(c, 200), 256).alias("block_sha"),
        F.sha2(T.highlight(c, ["The", "tioN"]), 256).alias("marked_sha"), T.body_hash(c).alias("body_sha"),
        F.round(T.match_density(F.col("n_chars"), F.col("n_chars")), 9).alias("density"),
    )
