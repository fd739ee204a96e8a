"""Registered queries of sources, column functions, identity checks and streams.

The transcripts, stores and logs that they read are derived from the driver's tables: a conversation is a transcript file, its turns are lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.operators import ingest, relevance, search
from sessionlake.operators.requests import ABANDONED, DIMENSIONS
from sessionlake.plans.catalog import _bodies, _read, register
from sessionlake.sources import bundles, growing_logs, stores
from sessionlake.sources import transcripts as S
from sessionlake.streaming import captures, ledger


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that spark.checkpoint.dir names (the warehouse's without one)."""
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with place, stamp and the JSON text of the text; a null text is an empty one."""
    return _read(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").cast("int").alias("line_no"), "role", F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file_path"),
        F.concat(F.lit("2026-01-01T00:00:0"), (F.col("turn") % 10).cast("string"), F.lit("Z")).alias("stamp"), F.lit(True).alias("valid"),
        F.timestamp_seconds("conv_id").alias("file_mtime"),
    )


def _json(**fields):
    """A JSON object of constant or column values, without nulls."""
    return F.to_json(F.struct(*[(v if not isinstance(v, (str, int)) else F.lit(v)).alias(k) for k, v in fields.items()]))


_STAMP = "'2026-01-01T00:00:0' || turn % 10 || 'Z'"
_CONV = "(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) v WHERE true"


def _with_input(line):
    """A line with its mark "@@" replaced by an input of each JSON type: an object, a list, a text, a number, null, none at all."""
    n = F.col("line_no").cast("string")
    kinds = [F.concat(F.lit('{"n":'), n, F.lit("}")), F.concat(F.lit('["x",'), n, F.lit("]")), F.concat(F.lit('"say \\"'), n, F.lit('\\""')), n, F.lit("null")]
    given = F.element_at(F.array(*kinds), (F.col("conv_id") % 6 + 1).cast("int"))
    return F.when(F.col("conv_id") % 6 == 5, F.replace(line, F.lit(',"input":"@@"'), F.lit(""))).otherwise(F.replace(line, F.lit('"input":"@@"'), F.concat(F.lit('"input":'), given)))


_INDENTED = (
    "CASE conv_id % 6 WHEN 0 THEN '{{' || chr(10) || '  \"n\": ' || turn || chr(10) || '}}' WHEN 1 THEN '[' || chr(10) || '  \"x\",' || chr(10) || '  ' || turn || chr(10) || ']' "
    "WHEN 2 THEN '\"say \\\"' || turn || '\\\"\"' WHEN 3 THEN CAST(turn AS VARCHAR) WHEN 4 THEN 'null' ELSE '{{}}' END"
).replace("{{", "{").replace("}}", "}")
_SPACED = "CASE conv_id % 6 WHEN 0 THEN '{\"n\": ' || turn || '}' WHEN 1 THEN '[\"x\", ' || turn || ']' WHEN 2 THEN '\"say \\\"' || turn || '\\\"\"' WHEN 3 THEN CASE WHEN turn <> 0 THEN CAST(turn AS VARCHAR) END END"


def _between_bad_lines(lines: DataFrame) -> DataFrame:
    """Every line followed by one that isn't JSON."""
    lines = lines.withColumn("line_no", 2 * F.col("line_no"))
    return lines.unionByName(lines.withColumn("line_no", F.col("line_no") + 1).withColumn("line", F.left("line", F.lit(9))).withColumn("valid", F.lit(False)))


def _claude_lines(spark, sf_dir):
    t = _turns(spark, sf_dir)
    said = _json(type="user", sessionId=F.col("conv_id").cast("string"), cwd="/w", timestamp=F.col("stamp"), message=F.struct(F.col("text").alias("content")))
    none = lambda name: F.lit(None).cast("string").alias(name)
    blocks = F.array(
        F.struct(F.lit("text").alias("type"), F.col("text"), none("id"), none("name"), none("input")),
        F.struct(F.lit("tool_use").alias("type"), none("text"), F.concat(F.lit("t"), F.col("line_no").cast("string")).alias("id"), F.lit("Bash").alias("name"), F.lit("@@").alias("input")),
    )
    answered = _with_input(_json(type="assistant", timestamp=F.col("stamp"), message=F.struct(F.lit("m").alias("model"), blocks.alias("content"))))
    lines = t.withColumn("line", F.when(F.col("role") == "user", said).when(F.col("role") == "assistant", answered).otherwise(_json(type="system")))
    return _between_bad_lines(lines)


_CLAUDE = f"""WITH b AS (
  SELECT conv_id, turn, 0 AS b, role, NULL AS tool_name, text FROM {_CONV} AND role IN ('user', 'assistant') AND text <> ''
  UNION ALL SELECT conv_id, turn, 1, 'tool_call', 'Bash', {_INDENTED} FROM {_CONV} AND role = 'assistant')
"""


def _claude_results(spark, sf_dir):
    """After all turns: for each call its result, a second call under the same id, and that one's result."""
    t = _turns(spark, sf_dir).where("role = 'assistant'").withColumn("line_no", 10_000 + 10 * F.col("line_no"))
    id_ = F.concat(F.lit("t"), ((F.col("line_no") - 10_000) / 10).cast("int").cast("string"))
    result = lambda text: _json(type="user", message=F.struct(F.array(F.struct(F.lit("tool_result").alias("type"), id_.alias("tool_use_id"), F.lit(text).alias("content"))).alias("content")))
    call = _json(type="assistant", message=F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), id_.alias("id"), F.lit("Read").alias("name"))).alias("content")))
    lines = [t.withColumn("line", line).withColumn("line_no", F.col("line_no") + n) for n, line in enumerate((result("r1"), call, result("r2")))]
    return reduce(DataFrame.unionByName, lines)


_RESULTS = "".join(f" UNION ALL SELECT conv_id, 10000 + 10 * turn + {n}, 0, '{role}', '{name}', '{text}' FROM {_CONV} AND role = 'assistant'" for n, role, name, text in ((0, "tool_result", "Bash", "r1"), (1, "tool_call", "Read", "{}"), (2, "tool_result", "Read", "r2")))


@register(
    "claude_entries",
    f"{_CLAUDE}, r AS (SELECT * FROM b {_RESULTS}) SELECT 'f' || conv_id || '.jsonl' AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, b) - 1 AS seq, role, tool_name, sha256(text) AS text_sha FROM r",
    plain=True,
)
def _(spark, sf_dir):
    e = S.claude_entries(_claude_lines(spark, sf_dir).unionByName(_claude_results(spark, sf_dir)))
    return e.select("file_path", F.col("seq").cast("long").alias("seq"), "role", "tool_name", F.sha2("text", 256).alias("text_sha"))


@register(
    "claude_messages",
    f"""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN trim(text) ELSE concat_ws(chr(10), nullif(trim(text), ''), '[tool: Bash] ' || {_SPACED}) END AS t FROM {_CONV} AND role IN ('user', 'assistant'))
    SELECT 'f' || conv_id || '.jsonl' AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, sha256(t) AS text_sha FROM m WHERE t <> '' OR role = 'assistant'""",
    plain=True,
)
def _(spark, sf_dir):
    return S.claude_messages(_claude_lines(spark, sf_dir)).select("file_path", F.col("idx").cast("long").alias("idx"), "role", F.sha2("text", 256).alias("text_sha"))


@register(
    "claude_sessions",
    f"""SELECT 'f' || conv_id || '.jsonl' AS file_path, max(CASE WHEN role = 'user' THEN CAST(conv_id AS VARCHAR) END) AS session_id, max(CASE WHEN role = 'assistant' THEN 'm' END) AS model,
    arg_min({_STAMP}, turn) FILTER (role IN ('user', 'assistant')) AS started_at, arg_max({_STAMP}, turn) FILTER (role IN ('user', 'assistant')) AS ended_at FROM {_CONV} GROUP BY conv_id""",
    plain=True,
)
def _(spark, sf_dir):
    return S.claude_sessions(_claude_lines(spark, sf_dir)).select("file_path", "session_id", "model", "started_at", "ended_at")


def _codex_lines(spark, sf_dir):
    t = _turns(spark, sf_dir)
    message = F.struct(F.lit("message").alias("type"), F.col("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("text"))).alias("content"))
    wrapped = _json(type="response_item", timestamp=F.col("stamp"), payload=message)
    inlined = _json(type="message", timestamp=F.col("stamp"), role=F.col("role"), content=F.array(F.struct(F.lit("output_text").alias("type"), F.col("text"))))
    lines = t.withColumn("line", F.when(F.col("line_no") % 2 == 0, wrapped).otherwise(inlined)).withColumn("line_no", F.col("line_no") + 2)
    first = t.select("conv_id", "file_path", "valid", "file_mtime").distinct()
    meta = first.withColumn("line_no", F.lit(0)).withColumn("line", _json(type="session_meta", timestamp="t0", payload=F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("p").alias("model_provider"))))
    call = first.withColumn("line_no", F.lit(1)).withColumn("line", _json(type="response_item", timestamp="t1", payload=F.struct(F.lit("function_call").alias("type"), F.lit("sh").alias("name"), F.lit("k").alias("call_id"), F.lit("ls").alias("arguments"))))
    out = first.withColumn("line_no", F.lit(1000)).withColumn("line", _json(type="response_item", timestamp="t9", payload=F.struct(F.lit("function_call_output").alias("type"), F.lit("k").alias("call_id"), F.lit("done").alias("output"))))
    patch = _json(type="response_item", timestamp=F.col("stamp"), payload=F.struct(F.lit("custom_tool_call").alias("type"), F.lit("patch").alias("name"), F.lit("@@").alias("input")))
    patches = t.where("role = 'assistant'").withColumn("line", _with_input(patch)).withColumn("line_no", F.col("line_no") + 500)
    columns = ["file_path", "line_no", "line", "valid", "file_mtime"]
    parts = [x.select(columns) for x in (lines, meta, call, patches, out)]
    return _between_bad_lines(reduce(DataFrame.unionByName, parts))


@register(
    "codex_entries",
    f"""WITH b AS (SELECT conv_id, turn + 2 AS l, role, NULL AS tool_name, text FROM {_CONV} AND text <> ''
      UNION ALL SELECT DISTINCT conv_id, 1, 'tool_call', 'sh', 'ls' FROM {_CONV} UNION ALL SELECT DISTINCT conv_id, 1000, 'tool_result', 'sh', 'done' FROM {_CONV}
      UNION ALL SELECT conv_id, turn + 500, 'tool_call', 'patch', CASE WHEN conv_id % 6 = 4 OR conv_id % 6 = 3 AND turn = 0 THEN '{{}}' ELSE {_INDENTED} END FROM {_CONV} AND role = 'assistant'
      UNION ALL SELECT DISTINCT conv_id, 3001, 'tool_call', 'sh2', 'ls' FROM {_CONV} UNION ALL SELECT DISTINCT conv_id, 3002, 'tool_result', 'sh2', 'done' FROM {_CONV})
    SELECT 'f' || conv_id || '.jsonl' AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY l) - 1 AS seq, role, tool_name, sha256(text) AS text_sha FROM b""",
    plain=True,
)
def _(spark, sf_dir):
    lines = _codex_lines(spark, sf_dir)
    first = _turns(spark, sf_dir).select("file_path", "valid", "file_mtime").distinct()  # the same id is called again, under another name
    call = _json(type="response_item", payload=F.struct(F.lit("function_call").alias("type"), F.lit("sh2").alias("name"), F.lit("k").alias("call_id"), F.lit("ls").alias("arguments")))
    out = _json(type="response_item", payload=F.struct(F.lit("function_call_output").alias("type"), F.lit("k").alias("call_id"), F.lit("done").alias("output")))
    again = [first.withColumn("line_no", F.lit(n)).withColumn("line", x) for n, x in ((3001, call), (3002, out))]
    e = S.codex_entries(lines.unionByName(again[0]).unionByName(again[1]))
    return e.select("file_path", F.col("seq").cast("long").alias("seq"), "role", "tool_name", F.sha2("text", 256).alias("text_sha"))


@register(
    "codex_messages",
    f"""WITH b AS (SELECT conv_id, turn + 2 AS l, role, trim(text) AS t FROM {_CONV} AND role IN ('user', 'assistant') AND trim(text) <> '' UNION ALL SELECT DISTINCT conv_id, 1, 'tool', '[tool: sh] ls' FROM {_CONV})
    SELECT 'f' || conv_id || '.jsonl' AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY l) - 1 AS idx, role, sha256(t) AS text_sha FROM b""",
    plain=True,
)
def _(spark, sf_dir):
    return S.codex_messages(_codex_lines(spark, sf_dir)).select("file_path", F.col("idx").cast("long").alias("idx"), "role", F.sha2("text", 256).alias("text_sha"))


@register("codex_session_meta", f"SELECT DISTINCT 'f' || conv_id || '.jsonl' AS file_path, 'c' || conv_id AS session_id, 't0' AS started_at, 't9' AS ended_at, 'p' AS model FROM {_CONV}", plain=True)
def _(spark, sf_dir):
    lines = _codex_lines(spark, sf_dir)
    return S.codex_session_meta(lines, S.codex_entries(lines)).select("file_path", "session_id", "started_at", "ended_at", "model")


def _cursor_lines(spark, sf_dir):
    t = _turns(spark, sf_dir)
    text = F.when(F.col("role") == "user", F.concat(F.lit("<timestamp>"), "stamp", F.lit("</timestamp><user_query>"), "text", F.lit("</user_query>"))).otherwise(F.col("text"))
    none = lambda name: F.lit(None).cast("string").alias(name)
    said = F.struct(F.lit("text").alias("type"), text.alias("text"), none("name"), none("input"))
    call = F.struct(F.lit("tool_use").alias("type"), none("text"), F.lit("Edit").alias("name"), F.lit("@@").alias("input"))
    blocks = F.when(F.col("role") == "assistant", F.array(said, call)).otherwise(F.array(said))
    return _between_bad_lines(t.withColumn("line", _with_input(_json(role=F.col("role"), message=F.struct(blocks.alias("content"))))))


_STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@register(
    "cursor_entries",
    f"""WITH b AS (SELECT conv_id, turn, 0 AS b, role, {_STRIPPED} AS t, CASE WHEN role = 'user' THEN {_STAMP} END AS ts FROM {_CONV} AND role IN ('user', 'assistant')
      UNION ALL SELECT conv_id, turn, 1, 'tool_call', {_INDENTED}, NULL FROM {_CONV} AND role = 'assistant')
    SELECT 'f' || conv_id || '.jsonl' AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn, b) - 1 AS seq, role, ts, sha256(t) AS text_sha FROM b WHERE t <> ''""",
    plain=True,
)
def _(spark, sf_dir):
    e = S.cursor_entries(_cursor_lines(spark, sf_dir))
    return e.select("file_path", F.col("seq").cast("long").alias("seq"), "role", "ts", F.sha2("text", 256).alias("text_sha"))


@register(
    "cursor_messages",
    f"""WITH b AS (SELECT conv_id, turn, role, {_STRIPPED} AS t FROM {_CONV} AND role IN ('user', 'assistant'))
    SELECT 'f' || conv_id || '.jsonl' AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, sha256(t) AS text_sha FROM b WHERE t <> '' OR role = 'assistant'""",
    plain=True,
)
def _(spark, sf_dir):
    return S.cursor_messages(_cursor_lines(spark, sf_dir)).select("file_path", F.col("idx").cast("long").alias("idx"), "role", F.sha2("text", 256).alias("text_sha"))


@register(
    "read_raw_lines",
    f"""SELECT conv_id % 32 AS part, row_number() OVER (PARTITION BY conv_id % 32 ORDER BY conv_id, turn, role, text) AS line_no, conv_id % 5 <> 0 AS valid,
    sha256(conv_id || role || text) AS text_sha FROM {_CONV}""",
    plain=True,
)
def _(spark, sf_dir):
    """Files of many conversations, begun by a blank line; lines end in a carriage return, those of every fifth conversation aren't JSON."""
    t, path = _turns(spark, sf_dir).withColumn("part", F.col("conv_id") % 32), _scratch(spark, "transcripts")
    line = F.concat(F.when(F.col("conv_id") % 5 == 0, "x").otherwise(""), _json(id=F.col("conv_id"), role=F.col("role"), text=F.col("text")), F.lit("\r"))
    blank = spark.range(32).select(F.col("id").alias("part"), F.lit(-1).cast("long").alias("conv_id"), F.lit(0).alias("line_no"), F.lit("").alias("role"), F.lit("").alias("value"))
    rows = t.select("part", "conv_id", "line_no", "role", line.alias("value")).unionByName(blank)
    rows = rows.repartition(32, "part").sortWithinPartitions("part", "conv_id", "line_no", "role", "value")
    rows.select("part", "value").write.partitionBy("part").text(path)
    body = F.when(F.col("valid"), F.col("line")).otherwise(F.substring("line", 2, 1 << 30))
    text = F.concat(*[F.get_json_object(body, f"$.{k}") for k in ("id", "role", "text")])
    part = F.regexp_extract("file_path", "part=([0-9]+)", 1).cast("long")
    return S.read_raw_lines(spark, path).select(part.alias("part"), F.col("line_no").cast("long").alias("line_no"), "valid", F.sha2(text, 256).alias("text_sha"))


@register("read_changed_files", f"SELECT conv_id % 32 AS part, count(*) AS n FROM {_CONV} AND conv_id % 2 = 0 GROUP BY 1", plain=True)
def _(spark, sf_dir):
    """Files of 32 parts, the odd ones last written years ago: an export of what changed since doesn't open those."""
    t, path = _turns(spark, sf_dir).withColumn("part", F.col("conv_id") % 32), _scratch(spark, "changed")
    lines = t.select("part", _json(id=F.col("conv_id"), role=F.col("role"), text=F.col("text")).alias("value"))
    lines.repartition(32, "part").write.partitionBy("part").text(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(hadoop.Path(f"{path}/part=*[13579]/*.txt")):  # 16 files or few more
        files.setTimes(found.getPath(), 1_577_836_800_000, -1)
    part = F.regexp_extract("file_path", "part=([0-9]+)", 1).cast("long")
    return S.read_raw_lines(spark, path, since=datetime(2021, 1, 1, tzinfo=UTC)).groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@register(
    "classify_transcript_paths",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'codex' WHEN 1 THEN 'cursor' ELSE 'claude' END AS source, page_id % 4 = 2 AS is_subagent, page_id % 8 = 0 AS is_archived FROM pages""",
    plain=True,
)
def _(spark, sf_dir):
    i = F.col("page_id")
    n = i.cast("string")
    path = F.when(i % 8 == 0, F.concat(F.lit("/c/archived_sessions/rollout-"), n)).when(i % 4 == 0, F.concat(F.lit("/c/rollout-"), n)).when(i % 4 == 1, F.concat(F.lit("/x/agent-transcripts/"), n, F.lit("/"), n)).when(i % 4 == 2, F.concat(F.lit("/h/p/u/subagents/"), n)).otherwise(F.concat(F.lit("/h/p/"), n))
    pages = _read(spark, sf_dir, "pages").select("page_id", F.concat(path, F.lit(".jsonl")).alias("file_path"))
    return S.classify_transcript_paths(pages).select("page_id", "source", "is_subagent", "is_archived")


@register(
    "composer_entries",
    f"""WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM {_CONV} AND text <> '' UNION ALL SELECT DISTINCT conv_id, -1, 'user', '[chat title] chat' FROM {_CONV} AND text <> '')
    SELECT CAST(conv_id AS VARCHAR) AS composer_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, role, sha256(text) AS text_sha FROM b""",
    plain=True,
)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir)
    bubble = t.select(F.concat_ws(":", F.lit("bubbleId"), "conv_id", "line_no").alias("key"), _json(type=F.when(F.col("role") == "user", 1).otherwise(2), text=F.col("text")).alias("value"))
    headers = F.transform(F.array_sort(F.collect_list("line_no")), lambda n: F.struct(n.cast("string").alias("bubbleId")))
    chats = t.groupBy("conv_id").agg(headers.alias("h")).select(F.concat_ws(":", F.lit("composerData"), "conv_id").alias("key"), _json(name="chat", fullConversationHeadersOnly=F.col("h")).alias("value"))
    e = stores.composer_entries(bubble.unionByName(chats))
    return e.select("composer_id", F.col("seq").cast("long").alias("seq"), "role", F.sha2("text", 256).alias("text_sha"))


@register("composer_workspaces", f"SELECT CAST(conv_id AS VARCHAR) AS composer_id, '/w' || min(turn) AS folder FROM {_CONV} GROUP BY conv_id", plain=True)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir)
    ids = F.transform(F.collect_list(F.col("conv_id").cast("string")), lambda c: F.struct(c.alias("composerId")))
    kv = t.groupBy("line_no", F.floor(F.col("conv_id") / 100).alias("block")).agg(_json(allComposers=ids).alias("value"))  # 100 conversations at most
    folder = F.concat(F.lit("file:///w"), F.col("line_no").cast("string"))
    kv = kv.select(F.concat_ws("-", F.lpad(F.col("line_no").cast("string"), 10, "0"), "block").alias("workspace"), "value", folder.alias("folder"))
    return stores.composer_workspaces(kv.select("workspace", "value"), kv.select("workspace", "folder"))


@register(
    "order_blob_timeline",
    f"SELECT CAST(conv_id AS VARCHAR) AS chat_id, CAST(turn AS VARCHAR) AS blob_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE conv_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier FROM {_CONV}",
    plain=True,
)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir).select("conv_id", F.col("conv_id").cast("string").alias("chat_id"), F.col("line_no").alias("pos"), F.col("line_no").cast("string").alias("blob_id"))
    none = F.lit(None).cast("string")
    tree = F.concat(F.lit("t"), F.floor(F.col("pos") / 3).cast("string"))
    walk = t.where("conv_id % 3 = 0")
    roots = walk.select("chat_id", none.alias("parent"), F.lit(8).alias("field_no"), F.floor(F.col("pos") / 3).cast("int").alias("pos"), tree.alias("child")).distinct()
    inner = walk.select("chat_id", tree.alias("parent"), F.lit(1).alias("field_no"), "pos", F.col("blob_id").alias("child"))
    flat = t.where("conv_id % 3 = 1").select("chat_id", none.alias("parent"), F.lit(1).alias("field_no"), "pos", F.col("blob_id").alias("child"))
    leaves = t.select("chat_id", "blob_id", F.col("pos").alias("insert_pos"), F.lit(False).alias("references_other"), F.lit(False).alias("is_root"))
    return stores.order_blob_timeline(roots.unionByName(inner).unionByName(flat), leaves).withColumn("seq", F.col("seq").cast("long"))


@register("role_content_rows", f"SELECT conv_id || '-' || turn AS blob_id, role, sha256(text) AS text_sha FROM {_CONV} AND role IN ('system', 'user', 'assistant', 'tool')", plain=True)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir)
    body = F.when(F.col("line_no") % 2 == 0, _json(role=F.col("role"), content=F.col("text"))).otherwise(_json(role=F.col("role"), content=F.array(F.struct(F.col("text")))))
    blobs = t.select(F.concat_ws("-", "conv_id", "line_no").alias("blob_id"), body.alias("body"))
    return stores.role_content_rows(blobs).select("blob_id", "role", F.sha2("text", 256).alias("text_sha"))


def _capture_lines(spark, sf_dir):
    """User turns are starts; other turns are two deltas, and complete if their number is even."""
    t = _turns(spark, sf_dir).withColumn("thread", F.concat(F.lit("th"), F.col("conv_id").cast("string")))
    base = F.col("line_no") * 4


    def rpc(order, direction, method, params):
        message = F.struct(F.lit(method).alias("method"), params.alias("params"))
        return F.struct(order.alias("line_no"), _json(type="rpc", captured_at=F.col("stamp"), sequence=order, direction=direction, message=message).alias("line"))

    item = F.concat(F.lit("i"), F.col("line_no").cast("string"))
    start = rpc(base + 1, "client_to_server", "turn/start", F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("input")))
    deltas = [rpc(base + 1 + k, "server_to_client", "item/agentMessage/delta", F.struct(item.alias("itemId"), F.expr(f"substring(text, {'1' if k == 0 else 'cast(floor(length(text) / 2) as int) + 1'}, {'cast(floor(length(text) / 2) as int)' if k == 0 else 'length(text)'})").alias("delta"))) for k in (0, 1)]
    done = rpc(base + 3, "server_to_client", "item/completed", F.struct(F.struct(item.alias("id"), F.lit("agentMessage").alias("type"), F.col("text")).alias("item")))
    lines = F.when(F.col("role") == "user", F.array(start)).when(F.col("line_no") % 2 == 0, F.array(*deltas, done)).otherwise(F.array(*deltas))

    return t.select("thread", F.explode(lines).alias("l")).select("thread", "l.line_no", "l.line")


_CAPTURED = f"SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, trim(text) AS t FROM {_CONV} AND trim(text) <> ''"


@register("captured_chat_messages", f"SELECT 'th' || conv_id AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, sha256(t) AS text_sha FROM ({_CAPTURED}) c", plain=True)
def _(spark, sf_dir):
    m = stores.captured_chat_messages(_capture_lines(spark, sf_dir))
    return m.select("thread", F.col("idx").cast("long").alias("idx"), "role", F.sha2("text", 256).alias("text_sha"))


@register(
    "fallback_chat_messages",
    f"""WITH f AS (SELECT conv_id, turn, 'user' AS role, trim(text) AS t FROM {_CONV} AND role = 'user' AND trim(text) <> '' UNION ALL SELECT conv_id, turn, 'tool', '[tool: sh] ' || turn FROM {_CONV} AND role = 'assistant' UNION ALL SELECT DISTINCT conv_id, -1, 'user', 'not logged' FROM {_CONV})
    SELECT 'th' || conv_id AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, sha256(t) AS text_sha FROM f""",
    plain=True,
)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("thread", F.concat(F.lit("th"), F.col("conv_id").cast("string")))
    quoted = F.regexp_extract(_json(x=F.col("text")), r'(?s)^\{"x":(.*)\}$', 1)
    user = F.concat(F.lit("Op { items: [Text { text: "), quoted, F.lit(", text_elements: [] }] }"))
    tool = F.concat(F.lit("s:handle_output_item_done: ToolCall: sh "), F.col("line_no").cast("string"), F.lit("\n thread_id=x"))
    logs = t.where("role in ('user', 'assistant')").select(
        F.col("line_no").cast("long").alias("id"), F.col("line_no").cast("long").alias("ts"), F.lit(0).alias("ts_nanos"), "thread",
        F.when(F.col("role") == "user", "codex_core::session::handlers").otherwise("codex_core::stream_events_utils").alias("target"),
        F.when(F.col("role") == "user", user).otherwise(tool).alias("body"),
    )
    chats = t.select("thread").distinct().withColumn("prompts", F.array(F.lit("not logged")))
    return stores.fallback_chat_messages(chats, logs).select("thread", F.col("idx").cast("long").alias("idx"), "role", F.sha2("text", 256).alias("text_sha"))


@register(
    "merge_chat_copies",
    f"""WITH a AS (SELECT conv_id, turn, role, text FROM {_CONV} AND turn % 2 = 0), b AS (SELECT conv_id, turn, role, text FROM {_CONV}),
    m AS (SELECT *, 0 AS c FROM a UNION ALL SELECT *, 1 FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.conv_id = b.conv_id AND a.role = b.role AND a.text = b.text))
    SELECT conv_id AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY turn, c) - 1 AS idx, role, sha256(text) AS text_sha FROM m""",
    plain=True,
)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("thread"), F.col("line_no").alias("idx"), "role", F.col("line_no").cast("double").alias("ts"), "text")
    m = stores.merge_chat_copies(t.where("idx % 2 = 0"), t)
    return m.select("thread", F.col("idx").cast("long").alias("idx"), "role", F.sha2("text", 256).alias("text_sha"))


@register(
    "prompt_log",
    f"""SELECT 'claude' AS source, CAST(turn AS DOUBLE) AS ts, NULL AS session, '/p' AS project, sha256(text) AS prompt_sha FROM {_CONV} AND role = 'user' AND text <> '' AND conv_id % 3 = 0
    UNION ALL SELECT 'codex', CAST(turn AS DOUBLE), CAST(conv_id AS VARCHAR), CASE WHEN conv_id % 2 = 0 THEN '/c' END, sha256(text) FROM {_CONV} AND role = 'user' AND text <> '' AND conv_id % 3 = 1
    UNION ALL SELECT 'cursor', 5.0, 'f' || conv_id, NULL, sha256(arg_min(text, turn)) FROM {_CONV} AND role = 'user' AND text <> '' AND conv_id % 3 = 2 GROUP BY conv_id""",
    plain=True,
)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir).where("role = 'user'")
    claude = t.where("conv_id % 3 = 0").select(F.col("text").alias("display"), F.lit("/p").alias("project"), (F.col("line_no") * 1000).alias("timestamp"))
    codex = t.where("conv_id % 3 = 1").select("text", F.col("conv_id").cast("string").alias("session_id"), F.col("line_no").alias("ts"))
    sessions = t.where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("session_id"), F.lit("/c").alias("cwd")).distinct()
    cursor = t.where("conv_id % 3 = 2").select("file_path", F.col("line_no").alias("idx"), "role", "text", F.lit("5").alias("first_ts"))
    return stores.prompt_log(claude, codex, sessions, cursor).select("source", "ts", "session", "project", F.sha2("prompt", 256).alias("prompt_sha"))


@register("import_markers", f"SELECT 't' || conv_id AS thread_id, 'p' || max(turn) AS source_path, CASE WHEN conv_id % 2 = 0 THEN '/c' END AS cwd FROM {_CONV} GROUP BY conv_id ORDER BY max(turn) DESC, thread_id LIMIT 50", plain=True)
def _(spark, sf_dir):
    t = _turns(spark, sf_dir)
    record = F.struct("line_no", F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("imported_thread_id"), F.concat(F.lit("p"), F.col("line_no").cast("string")).alias("source_path"), F.col("line_no").cast("string").alias("imported_at"))
    files = t.groupBy("conv_id").agg(_json(records=F.array_sort(F.collect_list(record))).alias("value"))
    sessions = t.where("conv_id % 2 = 0").select(F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("session_id"), F.lit("/c").alias("cwd")).distinct()
    return relevance.list_imports(stores.import_markers(files), sessions).select("thread_id", "source_path", "cwd")


# Identity, imports, bundles and snapshots.


def _unprinted(t):
    """(sessions without fingerprints, entries, bodies) of all sessions as a client would publish them; entries of the corpus tables."""
    s = t["sessions"].select(
        "session_id", F.col("session_id").alias("arrival"), "source", "uuid", "repository", "cwd", "started_at", "ended_at", F.lit(None).cast("int").alias("entry_count"),
        F.concat(F.when(F.col("is_subagent"), "subagents/").otherwise(""), F.col("session_id").cast("string"), F.lit(".json")).alias("export_path"),
        F.concat(F.lit("f"), F.col("session_id").cast("string")).alias("session_fallback"),
    )
    header = T.entry_header(F.col("seq"), F.col("role"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    e = t["entries"].select("session_id", "seq", "role", F.lit(None).cast("string").alias("ts"), header.alias("header_line"), "blob_hash", F.col("blob_hash").alias("body_sha256"))
    key = T.session_key(F.col("source"), F.col("uuid"), F.col("started_at"), F.col("session_fallback"))
    return s.withColumn("session_key", key), e, _bodies(t)


def _printed(s, e, bodies):
    return s.join(ingest.session_fingerprints(s, e).withColumnRenamed("fingerprint", "session_fingerprint"), "session_id"), e, bodies


def _bundle(t):
    """(sessions, entries, bodies) of all sessions as a client would publish them, with fingerprints."""
    return _printed(*_unprinted(t))


def _empty(spark: SparkSession) -> ingest.Corpus:
    make = lambda schema: spark.createDataFrame([], schema)
    return ingest.Corpus(
        make("session_id long, person string, source string, uuid string, repository string, export_path string, cwd string, started_at string, ended_at string, entry_count int, is_subagent boolean, session_fingerprint string, session_key string"),
        make("session_id long, seq int, role string, ts string, header_line string, blob_hash string"), make("blob_hash string, nbytes long, nrefs long"),
        make("blob_hash string, body string"), make("export_path string, reason string, cwd string"),
    )


_STEMMED = """, w AS (SELECT session_id, seq, role, body, regexp_extract_all(lower(strip_accents(body)), '[\\p{L}\\p{N}]+') AS t FROM entries),
    h AS (SELECT w.session_id, seq, role, body, s.* EXCLUDE (session_id) FROM w JOIN sessions s USING (session_id)
      WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'thing(s|e|es|ed|ing|ings|ness|ful)?'))) > 0 AND len(list_filter(t, lambda x: regexp_full_match(x, 'rest(s|e|es|ed|ing|ings|ness|ful)?'))) > 0
      AND NOT is_subagent AND role IN ('user', 'assistant')),
    r AS (SELECT session_id, count(*) AS hit_count FROM h GROUP BY session_id ORDER BY 2 DESC, max(started_at) DESC, 1 LIMIT 20),
    c AS (SELECT session_id, count(*) AS entry_count FROM entries GROUP BY session_id)
    SELECT session_id, hit_count, CAST(entry_count AS INTEGER) AS entry_count, git_branch, cwd, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS hit_rank, seq, 't' || seq AS ts, sha256(body) AS body_sha
    FROM h JOIN r USING (session_id) JOIN c USING (session_id) QUALIFY hit_rank <= 20"""


@register("search_stemmed", _STEMMED)
def _(t):
    """The stemming index, its directory, entries and bodies written by bucket and home, read back and searched for inflected words."""
    spark, path = t["entries"].sparkSession, _scratch(t["entries"].sparkSession, "postings")
    sessions = t["sessions"].join(t["entries"].groupBy("session_id").agg(F.count("*").cast("int").alias("entry_count")), "session_id")
    entries = t["entries"].select("session_id", "seq", "role", F.concat(F.lit("t"), F.col("seq").cast("string")).alias("ts"), F.lit("").alias("header_line"), "blob_hash")
    bundles.write_homes(entries, f"{path}/entries")
    bundles.write_homes(t["entries"].select("blob_hash", "body"), f"{path}/bodies", once=True)
    entries, texts = bundles.read_homes(spark, bundles.ENTRIES, f"{path}/entries"), bundles.read_homes(spark, bundles.BODIES, f"{path}/bodies")
    bundles.write_index(texts, f"{path}/postings", "porter")
    postings = bundles.read_postings(spark, f"{path}/postings")
    bundles.write_terms(spark, f"{path}/postings", f"{path}/terms")
    found = search.search(postings, entries, sessions, texts, "Things resting", limit=20, hits_per_session=20, max_chars=1 << 30, analyzer="porter", terms=bundles.read_terms(spark, f"{path}/terms"))
    return found.select("session_id", "hit_count", "entry_count", "git_branch", "cwd", F.explode("hits").alias("h")).select(
        "session_id", "hit_count", "entry_count", "git_branch", "cwd", F.col("h.hit_rank").cast("long").alias("hit_rank"), "h.seq", "h.ts", F.sha2("h.body", 256).alias("body_sha")
    )


@register("verify_session_identity", "SELECT session_id, 'session_key_mismatch' AS violation FROM sessions WHERE session_id % 10 = 3 UNION ALL SELECT session_id, 'session_fingerprint_mismatch' FROM sessions WHERE session_id % 10 = 4")
def _(t):
    s, e, _ = _bundle(t)
    s = s.withColumn("session_key", F.when(F.col("session_id") % 10 == 3, "forged").otherwise(F.col("session_key")))
    s = s.withColumn("session_fingerprint", F.when(F.col("session_id") % 10 == 4, F.lit("0" * 64)).otherwise(F.col("session_fingerprint")))
    return ingest.verify_session_identity(s, e)


@register("backfill_fingerprints", "SELECT session_id FROM sessions UNION ALL SELECT 5000000 + session_id FROM sessions WHERE session_id % 4 = 1")
def _(t):
    """Every session without a fingerprint; every third again under a larger id, which goes, every fourth again with other lines, which stays."""
    s, e, _ = _bundle(t)
    again = lambda df, at, rest: df.where(f"session_id % {rest[0]} = {rest[1]}").withColumn("session_id", F.col("session_id") + at)
    s = s.unionByName(again(s, 9_000_000, (3, 0))).unionByName(again(s, 5_000_000, (4, 1)))
    other = again(e, 5_000_000, (4, 1)).withColumn("header_line", F.concat("header_line", F.lit(" again")))
    e = e.unionByName(again(e, 9_000_000, (3, 0))).unionByName(other)
    s = s.withColumn("person", F.lit("p")).withColumn("session_fingerprint", F.lit(None).cast("string"))
    return ingest.backfill_fingerprints(s, e)[0].select("session_id")


def _allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"GitHub.com/acme/R{i}",) for i in range(3)], "repository string")


def _bundles(t):
    """Two bundles: the even sessions; then the odd ones, and of the even ones a third again as they are, a third as a newer generation (without its
    first entry, with one more) and a third as an older one. Repositories are in capitals here."""
    s, e, bodies = _unprinted(t)
    s = s.withColumn("repository", F.upper("repository"))
    part = lambda df, rest, at: df.where(f"session_id % 6 = {rest}").withColumn("session_id", F.col("session_id") + at)
    newer = part(s, 2, 20_000_000).withColumn("ended_at", F.lit("2027-01-01T00:00:00Z"))
    older = part(s, 4, 30_000_000).withColumn("ended_at", F.lit("2020-01-01T00:00:00Z"))
    sessions = s.where("session_id % 2 = 1").unionByName(part(s, 0, 10_000_000)).unionByName(newer).unionByName(older).withColumn("arrival", F.col("session_id"))
    text = F.concat(F.lit("extra "), F.col("session_id").cast("string"))
    extra = newer.select("session_id", F.lit(9999).alias("seq"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("ts"), F.lit("### [9999]").alias("header_line"), text.alias("body"))
    added, extra_bodies = ingest.content_address(extra)
    changed = part(e, 4, 30_000_000).withColumn("header_line", F.concat("header_line", F.lit("!")))
    entries = e.where("session_id % 2 = 1").unionByName(part(e, 0, 10_000_000)).unionByName(part(e, 2, 20_000_000).where("seq > 0")).unionByName(changed)
    entries = entries.unionByName(added.withColumn("body_sha256", F.col("blob_hash")))
    first = (s.where("session_id % 2 = 0"), e.where("session_id % 2 = 0"), bodies)
    second = (sessions, entries, bodies.unionByName(extra_bodies.select("blob_hash", "body")))
    return _printed(*first), _printed(*second)


_MERGED = """, ok AS (SELECT session_id AS id, session_id % 6 AS k FROM sessions WHERE repository <> 'github.com/acme/r3'),
    e AS (SELECT CASE WHEN k = 2 THEN 20000000 + id ELSE id END AS session_id, blob_hash FROM entries JOIN ok ON session_id = id WHERE k <> 2 OR seq > 0
      UNION ALL SELECT 20000000 + id, sha256('extra ' || 20000000 + id) FROM ok WHERE k = 2),
    b AS (SELECT DISTINCT blob_hash FROM entries JOIN ok ON session_id = id UNION SELECT blob_hash FROM e),
    w AS (SELECT CASE WHEN repository = 'github.com/acme/r3' THEN 'repository_not_allowed' WHEN session_id % 6 = 0 THEN 'duplicate_session_content' ELSE 'stale_session_generation' END AS reason
      FROM sessions WHERE repository = 'github.com/acme/r3' OR session_id % 6 IN (0, 4)
      UNION ALL SELECT 'repository_not_allowed' FROM sessions WHERE repository = 'github.com/acme/r3' AND session_id % 2 = 0)
    SELECT 'session' AS kind, CAST(session_id AS VARCHAR) AS name, count(*) AS n FROM e GROUP BY session_id
    UNION ALL SELECT 'blob', b.blob_hash, count(e.blob_hash) FROM b LEFT JOIN e USING (blob_hash) GROUP BY b.blob_hash
    UNION ALL SELECT 'skipped', reason, count(*) FROM w GROUP BY reason
    UNION ALL SELECT 'posting', 'extra', count(DISTINCT blob_hash) FROM e WHERE blob_hash IN (SELECT sha256('extra ' || 20000000 + id) FROM ok)"""


def _contents(c: ingest.Corpus) -> DataFrame:
    """kind, name and n: entries of each session, references of each blob, skipped sessions by reason, bodies under one word of the index."""
    row = lambda kind, name: (F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    return (
        c.entries.join(c.sessions.select("session_id"), "session_id").groupBy(*row("session", F.col("session_id"))).agg(F.count("*").alias("n"))
        .unionByName(c.blobs.select(*row("blob", F.col("blob_hash")), F.col("nrefs").cast("long").alias("n")))
        .unionByName(c.skipped.groupBy(*row("skipped", F.col("reason"))).agg(F.count("*").alias("n")))
        .unionByName(c.postings.where("term = 'extra'").groupBy(*row("posting", F.col("term"))).agg(F.count("*").alias("n")))
    )


@register("merge_import", _MERGED)
def _(t):
    """The second bundle merged into the corpus that the first one made."""
    spark = t["entries"].sparkSession
    at = _scratch(spark, "merge")
    for n, bundle in enumerate(_bundles(t)):
        bundles.write_bundle(*bundle, f"{at}/{n}")
    first, second = (bundles.read_bundle(spark, f"{at}/{n}") for n in range(2))
    bundles.write_snapshot(ingest.merge_import(_empty(spark), *first, "ann", _allowed(spark)), f"{at}/corpus")
    live = bundles.read_snapshot(spark, f"{at}/corpus")

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{at}/decided")
        return spark.read.schema(df.schema).parquet(f"{at}/decided")

    return _contents(ingest.applied(live, ingest.import_delta(live, *second, "ann", _allowed(spark), keep)))


_IMPORTED = f"""{_MERGED}
    UNION ALL SELECT 'kept', '1', count(*) FILTER (k IN (0, 4)) FROM ok
    UNION ALL SELECT 'kept', '2', count(*) FILTER (k % 2 = 1 OR k = 2) FROM ok
    UNION ALL SELECT 'refused', 'session_key_mismatch', 1"""


@register("stream_ingest", _IMPORTED)
def _(t):
    """A queue of the first bundle, one with a forged key, the second bundle and the first one again: the last is known and only renews its ledger row."""
    spark = t["entries"].sparkSession
    at = _scratch(spark, "ingest")
    first, second = _bundles(t)
    bundles.write_bundle(*first, f"{at}/1")
    bundles.write_bundle(*second, f"{at}/2")
    bundles.write_bundle(second[0].withColumn("session_key", F.lit("0" * 64)), *second[1:], f"{at}/forged")
    rows = [(0, f"{at}/1", "ann"), (1, f"{at}/forged", "ann"), (2, f"{at}/2", "ann"), (3, f"{at}/1", "ann")]
    spark.createDataFrame(rows, "queued_at int, path string, person string").write.parquet(f"{at}/queue")
    queue = spark.readStream.schema("queued_at int, path string, person string").parquet(f"{at}/queue")
    ledger.stream_ingest(queue, f"{at}/corpus", f"{at}/state", _allowed(spark), lambda: _empty(spark)).awaitTermination()
    c = bundles.read_snapshot(spark, f"{at}/corpus")
    order = F.row_number().over(Window.orderBy("imported_at"))  # two rows
    kept = c.imports.select(F.lit("kept").alias("kind"), order.cast("string").alias("name"), F.col("sessions_kept").alias("n"))
    refused = spark.read.parquet(f"{at}/corpus/refused").select(F.lit("refused").alias("kind"), F.substring_index("reason", " ", 1).alias("name"), F.lit(1).cast("long").alias("n"))
    return _contents(c).unionByName(kept).unionByName(refused)


@register(
    "repaired_bundle",
    """SELECT 'outcome' AS kind, 'imported' AS name, 2 AS n UNION ALL SELECT 'outcome', 'replayed', 1
    UNION ALL SELECT 'session', CAST(session_id AS VARCHAR), count(*) FROM entries GROUP BY session_id
    UNION ALL SELECT 'skipped', CASE WHEN session_id % 3 = 0 THEN 'missing_entries_member' ELSE 'duplicate_session_content' END, count(*) FROM sessions GROUP BY 1, 2
    UNION ALL SELECT 'blob', blob_hash, count(*) FROM entries GROUP BY blob_hash""",
)
def _(t):
    """A bundle without the entries of every third session, then whole, then whole again: the second is another bundle, the third a replay."""
    spark = t["entries"].sparkSession
    at = _scratch(spark, "repaired")
    s, e, bodies = _bundle(t)
    s = s.withColumn("arrival", F.col("session_id"))
    told = []
    for n, sent, times in ((1, e.where("session_id % 3 <> 0"), 1), (2, e, 2)):
        bundles.write_bundle(s, sent, bodies, f"{at}/{n}")
        told += [ledger.ingest_one(spark, f"{at}/corpus", f"{at}/{n}", "ann", None, lambda: _empty(spark)) for _ in range(times)]
        bundles.delete(spark, f"{at}/{n}")
    outcomes = spark.createDataFrame([("outcome", x, told.count(x)) for x in sorted(set(told))], "kind string, name string, n long")
    return outcomes.unionByName(_contents(bundles.read_snapshot(spark, f"{at}/corpus")).where("kind in ('session', 'skipped', 'blob')"))


# Column functions.


@register(
    "column_functions",
    """SELECT session_id, CAST(epoch(CAST(replace(started_at, 'Z', '') AS TIMESTAMP)) AS DOUBLE) AS sort_ts, replace(substr(started_at, 1, 16), 'T', ' ') AS shown,
    replace(replace(substr(started_at, 1, 16), '-', ''), ':', '')  AS stamp0, 'p' || session_id % 5 || '/r' || session_id % 4 AS tail, person = 'person1' AS under,
    'home-p' || session_id % 5 || '-r' || session_id % 4 AS slug, '### [' || lpad(CAST(session_id % 10000 AS VARCHAR), 4, '0') || '] role=user ts=' || started_at AS header,
    source || '__' || session_id AS archive, 'f' || session_id AS fallback, 'user-' || session_id AS label, 'github.com/acme/r' || session_id % 4 AS selector, 'ab' AS clean FROM sessions""",
)
def _(t):
    i, n = F.col("session_id"), F.col("session_id").cast("string")
    s = F.col("started_at")
    return t["sessions"].select(
        "session_id", T.sort_ts(s).alias("sort_ts"), T.display_ts(s).alias("shown"), F.replace(T.file_timestamp(s), F.lit("-"), F.lit("T")).alias("stamp0"),
        T.path_tail(F.col("cwd")).alias("tail"), T.path_under(F.col("cwd"), F.lit("/home/p1/")).alias("under"), T.slug(F.col("cwd")).alias("slug"),
        T.entry_header(i % 10000, F.lit("user"), F.lit(None).cast("string"), s).alias("header"),
        T.archive_id(F.col("source"), n, F.concat(F.col("source"), F.lit("/"), n)).alias("archive0"), F.concat("source", F.lit("__"), n).alias("archive"),
        T.legacy_fallback(F.concat(F.lit("d/f"), n, F.lit("__unknown-time__x.md")), F.col("uuid")).alias("fallback"), T.person_label(F.concat(F.lit("User."), n, F.lit("@x.org"))).alias("label"),
        T.repository_selector(F.concat(F.lit("Acme/r"), (i % 4).cast("string"))).alias("selector"), T.sanitize(F.lit("a\x00b")).alias("clean"),
    ).drop("archive0")


# Streams over the tables: each runs until the table is read, into a table of the shared folder.


def _drained(df: DataFrame, mode: str, at: str | None = None, timers: bool = False) -> DataFrame:
    spark, at = df.sparkSession, at or _scratch(df.sparkSession, "stream")
    query = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("append").parquet(f"{at}/out")).outputMode(mode)
    # Processing-time timers keep a query going after its last row; those of event time are due by then. Python sources are read to their end in several batches only with the wrapper.
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": str(timers).lower(), "spark.sql.streaming.triggerAvailableNowWrapper.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _streamed(df: DataFrame) -> DataFrame:
    at = _scratch(df.sparkSession, "stream-in")
    df.write.parquet(at)
    return df.sparkSession.readStream.schema(df.schema).parquet(at)


@register(
    "stream_request_counts",
    " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value, count(*) AS n FROM requests GROUP BY 2" for d in DIMENSIONS),
)
def _(t):
    requests = t["requests"].withColumn("started_at", F.col("started_at").cast("timestamp"))
    twice = requests.unionByName(requests.where("id % 3 = 0"))
    return _drained(ledger.stream_request_counts(_streamed(twice)), "update")


@register("stream_upload_state", "SELECT 'u' || id // 4 AS upload_id, CASE max(id % 4) WHEN 0 THEN 'prepared' WHEN 1 THEN 'receiving' WHEN 2 THEN 'uploaded' ELSE 'queued' END AS status FROM requests GROUP BY id // 4")
def _(t):
    order = F.array(*map(F.lit, ("prepare", "receive", "received", "commit")))
    events = t["requests"].select(
        F.concat(F.lit("u"), F.floor(F.col("id") / 4).cast("string")).alias("upload_id"), F.col("id").alias("event_no"), F.element_at(order, (F.col("id") % 4 + 1).cast("int")).alias("event"),
        F.col("actor").alias("owner"), F.col("id").alias("nbytes"), F.col("id").cast("double").alias("at"),
    )
    return _drained(ledger.stream_upload_state(_streamed(events)), "update").select("upload_id", "status")


@register(
    "stream_upload_expiry",
    """SELECT 'u' || id // 4 AS upload_id, CASE max(id % 4) WHEN 0 THEN 'prepared' WHEN 1 THEN 'receiving' WHEN 2 THEN 'uploaded' ELSE 'queued' END AS status FROM requests WHERE id % 4 <= id // 4 % 4 GROUP BY id // 4
    UNION ALL SELECT 'u' || id // 4, 'expired' FROM requests WHERE id % 4 <= id // 4 % 4 GROUP BY id // 4 HAVING max(id % 4) IN (@ABANDONED)
    UNION ALL SELECT 'last', 'prepared'""".replace("@ABANDONED", ", ".join(str(i) for i, s in enumerate(("prepared", "receiving", "uploaded", "queued")) if s in ABANDONED)),
)
def _(t):
    """Uploads that stop after one to four events; then, in a second run of the stream, an event of a later year, by when those that were abandoned have expired."""
    spark, at = t["requests"].sparkSession, _scratch(t["requests"].sparkSession, "expiry")
    order = F.array(*map(F.lit, ("prepare", "receive", "received", "commit")))
    upload, place = F.floor(F.col("id") / 4), F.col("id") % 4
    events = t["requests"].where(place <= upload % 4).select(
        F.concat(F.lit("u"), upload.cast("string")).alias("upload_id"), F.col("id").alias("event_no"), F.element_at(order, (place + 1).cast("int")).alias("event"),
        F.col("actor").alias("owner"), F.col("id").alias("nbytes"), F.lit(1_700_000_000.0).alias("at"),
    )
    events.write.parquet(f"{at}/in")
    read = lambda: ledger.stream_upload_state(spark.readStream.schema(events.schema).parquet(f"{at}/in"))
    _drained(read(), "update", at, timers=True)
    last = [F.lit("last"), F.lit(0).cast("long"), F.lit("prepare"), F.lit("o"), F.lit(1).cast("long"), F.lit(1_800_000_000.0)]
    spark.range(1).select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(last, events.schema, strict=True)]).write.mode("append").parquet(f"{at}/in")
    return _drained(read(), "update", at, timers=True).select("upload_id", "status")


@register(
    "stream_capture_messages",
    f"SELECT 'th' || conv_id AS thread, role, role = 'user' OR turn % 2 = 0 AS complete, sha256(t) AS text_sha FROM ({_CAPTURED}) c",
    plain=True,
)
def _(spark, sf_dir):
    """The stream is read to its end, then a line of another thread comes that is a day later, by when the others' open items are due."""
    at, lines = _scratch(spark, "capture"), _capture_lines(spark, sf_dir)
    lines.write.parquet(f"{at}/in")
    read = lambda: captures.stream_capture_messages(spark.readStream.schema(lines.schema).parquet(f"{at}/in"))
    _drained(read(), "append", at, timers=True)
    spark.range(1).select(F.lit("last").alias("thread"), F.lit(1).alias("line_no"), _next_day().alias("line")).write.mode("append").parquet(f"{at}/in")
    out = _drained(read(), "append", at, timers=True)
    return out.select("thread", "role", "complete", F.sha2("text", 256).alias("text_sha"))


def _next_day():
    """A user's line without text, a day after all others."""
    said = F.struct(F.array(F.struct(F.lit("text").alias("type"), F.lit("").alias("text"))).alias("input"))
    return _json(type="rpc", captured_at="2026-01-02T00:00:00Z", sequence=1, direction="client_to_server", message=F.struct(F.lit("turn/start").alias("method"), said.alias("params")))


def _write_logs(texts: DataFrame, folder: str) -> None:
    """Texts (thread, line_no, text) into a log for each thread, in order of line_no, by tasks; a log that is there already is replaced."""

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = growing_logs.open_store(folder)
        store.create_dir(root, recursive=True)
        thread, log = None, None
        for part in parts:
            for row in part.itertuples(index=False):
                if row.thread != thread:
                    if log:
                        log.close()
                    thread, log = row.thread, store.open_output_stream(f"{root}/{row.thread}.jsonl")
                log.write(row.text.encode())
        if log:
            log.close()
        yield pd.DataFrame({"n": [1]})

    texts.select("thread", "line_no", "text").repartition("thread").sortWithinPartitions("thread", "line_no").mapInPandas(write, "n long").count()


@register(
    "stream_growing_logs",
    f"SELECT 'th' || conv_id AS thread, role, role = 'user' OR turn % 2 = 0 AS complete, sha256(t) AS text_sha FROM ({_CAPTURED}) c",
    plain=True,
)
def _(spark, sf_dir):
    """A log for each thread: in the stream's first run each ends within the first line of its second turn, before the second run the rest is there, before the last one a later log."""
    at, lines = _scratch(spark, "growing"), _capture_lines(spark, sf_dir)
    n = F.col("line_no")
    read = lambda: captures.stream_capture_messages(captures.capture_log_lines(growing_logs.stream_raw_lines(spark, f"{at}/in")))
    whole = F.concat("line", F.lit("\n"))
    half = F.left("line", F.floor(F.length("line") / 2).cast("int"))
    _write_logs(lines.where(n <= 5).withColumn("text", F.when(n < 5, whole).otherwise(half)), f"{at}/in")
    _drained(read(), "append", at, timers=True)
    _write_logs(lines.withColumn("text", whole), f"{at}/in")
    _drained(read(), "append", at, timers=True)
    _write_logs(spark.range(1).select(F.lit("last").alias("thread"), F.lit(1).alias("line_no"), F.concat(_next_day(), F.lit("\n")).alias("text")), f"{at}/in")
    out = _drained(read(), "append", at, timers=True)
    return out.select("thread", "role", "complete", F.sha2("text", 256).alias("text_sha"))


@register("correlate_forks", "SELECT 's' || event_id AS side_thread, 'p' || user_id AS parent FROM events WHERE event_id % 2 = 0", plain=True)
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", F.timestamp_seconds(F.lit(1_700_000_000)).alias("at"), F.lit("c").alias("connection"), F.col("event_id").cast("string").alias("id"))
    params = _json(ephemeral=F.lit(True), excludeTurns=F.col("event_id") % 2 == 0, threadId=F.concat(F.lit("p"), F.col("user_id").cast("string")))
    asked = e.select("connection", "id", "at", F.lit("thread/fork").alias("method"), params.alias("params"))
    told = e.select("connection", "id", "at", _json(thread=F.struct(F.concat(F.lit("s"), F.col("id")).alias("id"))).alias("result"))
    return _drained(captures.correlate_forks(_streamed(asked), _streamed(told)), "append").select("side_thread", "parent")


@register("filter_capture", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') OR event_id % 2 = 0", plain=True)
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    method = F.when(F.col("event_type") == "click", "thread/started").when(F.col("event_type") == "error", "error").otherwise("noise")
    direction = F.when(F.col("event_id") % 2 == 0, "client_to_server").otherwise("server_to_client")
    return captures.filter_capture(e.select("event_id", direction.alias("direction"), method.alias("method"))).select("event_id")
