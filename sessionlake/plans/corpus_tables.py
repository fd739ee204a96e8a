"""The corpus tables as views over the driver's tables, in Spark and, from the same text, in DuckDB.

Conversations are sessions of their own; documents are dealt to sessions of eight entries; forks repeat every tenth conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORK_AT, DOCUMENTS_AT = 2_000_000, 1_000_000


def _sha(engine: str, text: str) -> str:
    return f"sha2({text}, 256)" if engine == "spark" else f"sha256({text})"


def entries_sql(engine: str, forks: bool = False) -> str:
    more = f"""
    UNION ALL SELECT {FORK_AT} + conv_id, CAST(turn AS INT), role, text FROM conversations WHERE conv_id % 10 = 0""" if forks else ""
    return f"""
    SELECT conv_id AS session_id, CAST(turn AS INT) AS seq, role, text AS body FROM conversations
    UNION ALL SELECT {DOCUMENTS_AT} + CAST(floor(doc_id / 8) AS BIGINT), CAST(doc_id % 8 AS INT),
      CASE doc_id % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'tool_call' ELSE 'tool_result' END, text FROM documents{more}"""


def hashed_sql(engine: str, forks: bool = False) -> str:
    return f"SELECT session_id, seq, role, body, {_sha(engine, 'body')} AS blob_hash FROM ({entries_sql(engine, forks)}) e"


def sessions_sql(engine: str, forks: bool = False) -> str:
    ids = f"SELECT DISTINCT session_id AS id FROM ({entries_sql(engine, forks)}) e"
    return f"""
    SELECT id AS session_id, concat('person', CAST(id % 5 AS {_text(engine)})) AS person,
      CASE id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'cursor' END AS source,
      concat('github.com/acme/r', CAST(id % 4 AS {_text(engine)})) AS repository,
      concat('/home/p', CAST(id % 5 AS {_text(engine)}), '/r', CAST(id % 4 AS {_text(engine)})) AS cwd,
      concat('branch', CAST(id % 6 AS {_text(engine)})) AS git_branch, concat('model', CAST(id % 2 AS {_text(engine)})) AS model,
      substr({_sha(engine, f'CAST(id AS {_text(engine)})')}, 1, 32) AS uuid, (id % 7 = 3) AS is_subagent,
      concat('2026-0', CAST(1 + id % 9 AS {_text(engine)}), '-1', CAST(id % 10 AS {_text(engine)}), 'T0', CAST(id % 8 AS {_text(engine)}), ':00:00Z') AS started_at,
      concat('2026-0', CAST(1 + id % 9 AS {_text(engine)}), '-1', CAST(id % 10 AS {_text(engine)}), 'T1', CAST(id % 8 AS {_text(engine)}), ':00:00Z') AS ended_at
    FROM ({ids}) i"""


def _text(engine: str) -> str:
    return "STRING" if engine == "spark" else "VARCHAR"


def blobs_sql(engine: str, forks: bool = False) -> str:
    size = "octet_length(body)" if engine == "spark" else "strlen(body)"
    return f"""
    SELECT blob_hash, CAST(max({size}) AS BIGINT) AS nbytes, count(*) AS nrefs
    FROM ({hashed_sql(engine, forks)}) h GROUP BY blob_hash"""


def requests_sql(engine: str) -> str:
    return f"""
    SELECT event_id AS id, concat('r', CAST(event_id AS {_text(engine)})) AS request_id, ts AS started_at,
      concat('user', CAST(user_id AS {_text(engine)})) AS actor, CASE WHEN user_id % 3 = 0 THEN 'token' WHEN user_id % 3 = 1 THEN 'sso' END AS identity_kind,
      event_type AS mcp_name, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
      CASE WHEN event_type = 'error' THEN 'request_failed' END AS error_code, value AS duration_ms, props AS arguments_json
    FROM events"""


def tables(spark: SparkSession, sf_dir: str, forks: bool = False) -> dict[str, DataFrame]:
    """entries (with body and blob_hash), sessions, blobs and requests."""
    texts = {
        "entries": hashed_sql("spark", forks), "sessions": sessions_sql("spark", forks),
        "blobs": blobs_sql("spark", forks), "requests": requests_sql("spark"),
    }
    found = {}
    for name, text in texts.items():
        sources = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (("events",) if name == "requests" else ("conversations", "documents"))}
        for t in sources:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
        found[name] = spark.sql(text, **sources)
    return found


def with_tables(sql: str, forks: bool = False) -> str:
    """DuckDB SQL over entries, sessions, blobs and requests."""
    return f"""WITH entries AS ({hashed_sql('duckdb', forks)}), sessions AS ({sessions_sql('duckdb', forks)}),
    blobs AS ({blobs_sql('duckdb', forks)}), requests AS ({requests_sql('duckdb')})
    {sql}"""
