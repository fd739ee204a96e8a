"""Transcript logs of three tools as ordered entries and searchable messages.

``read_raw_lines`` gives one row per line; every ``*_entries`` function returns file_path, seq, role, ts, tool_name, text and raw, every
``*_messages`` function file_path, idx, role, ts, text and tools. A file is one session, so windows are per file. Lines that aren't JSON
are dropped (``valid`` tells).
"""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sessionlake.functions.text import nonempty, sort_ts, strip_noise

MOST_INPUT = 2000


def read_raw_lines(spark: SparkSession, *paths: str, since: datetime | None = None) -> DataFrame:
    """file_path, file_mtime, file_size, line_no (from 0), line and valid of every line that isn't blank.

    Files are read in splits; lines are numbered by the place of their split and their order in it. With ``since`` (a time with its zone) files last written
    before it, which can't hold a session that ends later, are left out when files are listed, and not opened.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if since:
        before = since.astimezone(UTC).replace(microsecond=0) - timedelta(seconds=1)  # modifiedAfter takes whole seconds, without the second itself
        reader = reader.option("modifiedAfter", f"{before:%Y-%m-%dT%H:%M:%S}").option("timeZone", "UTC")
    read = reader.text(list(paths))
    read = read.where(F.col("_metadata.file_modification_time") >= F.lit(since)) if since else read
    m = F.col("_metadata")
    lines = read.select(
        m.file_path.alias("file_path"), m.file_modification_time.alias("file_mtime"), m.file_size.alias("file_size"),
        m.file_block_start.alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )
    lines = _numbered(lines, "line_no", "start", "place").drop("start", "place")
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", "\r$", ""))).where("line <> ''")
    return lines.select("file_path", "file_mtime", "file_size", "line_no", "line", F.try_parse_json("line").isNotNull().alias("valid"))


def classify_transcript_paths(lines: DataFrame) -> DataFrame:
    """With source, is_subagent, is_archived and session_stem by path; files of no tool are dropped."""
    p = F.col("file_path")
    stem = F.regexp_extract(p, r"([^/]+)\.jsonl$", 1)
    parent = F.regexp_extract(p, r"/([^/]+)/subagents/", 1)
    codex = stem.startswith("rollout-")
    cursor = p.contains("/agent-transcripts/")
    source = F.when(codex, "codex").when(cursor, "cursor").when(p.endswith(".jsonl") & (stem != "journal"), "claude")
    marked = lines.withColumn("source", source).where("source is not null")
    sub = (F.col("source") == "claude") & (parent != "")
    return (
        marked.withColumn("is_subagent", sub)
        .withColumn("is_archived", codex & p.contains("/archived_sessions/"))
        .withColumn("session_stem", F.when(sub, F.concat_ws("/subagent/", parent, stem)).otherwise(stem))
    )


@F.pandas_udf(StringType())
def indented_json(values: pd.Series) -> pd.Series:
    """JSON text with two spaces of indent, non-ASCII kept; no built-in writes that form."""
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False))


@F.pandas_udf(StringType())
def sorted_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys and spaces after separators, non-ASCII kept."""
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v), ensure_ascii=False, sort_keys=True))


@F.pandas_udf(StringType())
def spaced_json(values: pd.Series) -> pd.Series:
    """JSON text with spaces after separators, in ASCII."""
    return values.map(lambda v: None if v is None else json.dumps(json.loads(v)))


def _at(c: Column | str, path: str) -> Column:
    return F.get_json_object(c, path)


def _kind(c: Column | str, path: str) -> Column:
    """The type of a JSON value: ARRAY..., OBJECT..., STRING, BIGINT, BOOLEAN...; null if absent."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), path, "variant"))


def _blocks(c: Column | str, path: str) -> Column:
    """A list's members as JSON text; a plain text becomes one text block; null members are dropped."""
    listed = F.from_json(_at(c, path), "array<string>")
    one = F.array(F.to_json(F.struct(F.lit("text").alias("type"), _at(c, path).alias("text"))))
    kind = _kind(c, path)
    return F.when(kind.startswith("ARRAY"), listed).when((kind == "STRING") & (_at(c, path) != ""), one)


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def _value(c: Column | str, path: str) -> Column:
    """The JSON text of the value at a path, strings with their quotes; null if it is absent."""
    kind = _kind(c, path)
    return F.when(kind == "STRING", _quoted(_at(c, path))).when(kind == "VOID", "null").otherwise(_at(c, path))


def _something(c: Column | str, path: str) -> Column:
    """Like ``_value``; null also for what counts as nothing: an empty text, list or object, zero, false and null."""
    value = _value(c, path)
    return F.when(~value.isin('""', "[]", "{}", "0", "0.0", "-0.0", "false", "null"), value)


def _time(c: Column | str, path: str) -> Column:
    """A time stamp as text; a number is epoch milliseconds."""
    text = nonempty(_at(c, path))
    at = F.timestamp_millis(text.try_cast("double").cast("long"))
    micros = F.when(F.date_format(at, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(at, "SSSSSS"))).otherwise("")
    iso = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), micros, F.lit("+00:00"))
    return F.when(_kind(c, path) == "STRING", text).when(text.isNotNull(), iso)


def _numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    window = Window.partitionBy("file_path").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window) - 1)


def _named_results(rows: DataFrame) -> DataFrame:
    """tool_name of results (call_id) from the latest earlier call of that id in the file: the last name is carried forward in one sorted sweep."""
    result = F.col("role") == "tool_result"
    tied = F.col("role").isin("tool_call", "tool_result") & F.col("call_id").isNotNull()
    before = Window.partitionBy("file_path", "call_id").orderBy("line_no", "block_no").rowsBetween(Window.unboundedPreceding, -1)
    called = F.last(F.when(F.col("role") == "tool_call", F.struct("tool_name")), ignorenulls=True).over(before)
    named = rows.where(tied).withColumn("called", called).withColumn("tool_name", F.when(result, F.col("called.tool_name")).otherwise(F.col("tool_name"))).drop("called")
    others = rows.where(~F.coalesce(tied, F.lit(False)))  # they have no part in the sweep, so they aren't one group
    return named.unionByName(others.withColumn("tool_name", F.when(result, F.lit(None)).otherwise(F.col("tool_name"))))


_ENTRY = ("file_path", "seq", "role", "ts", "tool_name", "text", "raw")


# The first tool: lines with type user or assistant, whose messages are lists of blocks.


def _claude_blocks(lines: DataFrame) -> DataFrame:
    typed = lines.where("valid").select("file_path", "line_no", "line", _at("line", "$.type").alias("type"), _time("line", "$.timestamp").alias("ts"))
    kept = typed.where(F.col("type").isin("user", "assistant")).withColumn("blocks", _blocks("line", "$.message.content"))
    rows = kept.select("file_path", "line_no", "line", "type", "ts", F.posexplode("blocks").alias("block_no", "block"))
    return rows.withColumn("kind", F.when(F.startswith("block", F.lit("{")), _at("block", "$.type")))


def claude_entries(lines: DataFrame) -> DataFrame:
    """Text, thinking, tool calls (their input as indented JSON) and tool results (their texts, else the raw list), in file order."""
    rows = _claude_blocks(lines).where("kind is not null")
    role = (
        F.when((F.col("kind") == "text"), F.col("type"))
        .when((F.col("type") == "assistant") & F.col("kind").isin("thinking"), "thinking")
        .when((F.col("type") == "assistant") & (F.col("kind") == "tool_use"), "tool_call")
        .when((F.col("type") == "user") & (F.col("kind") == "tool_result"), "tool_result")
    )
    parts = F.from_json(_at("block", "$.content"), "array<struct<type:string,text:string>>")
    texts = F.array_join(F.transform(F.filter(parts, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    result = F.when(_kind("block", "$.content").startswith("ARRAY"), F.coalesce(nonempty(texts), _at("block", "$.content"))).otherwise(F.coalesce(_at("block", "$.content"), F.lit("")))
    rows = rows.withColumn("role", role).where("role is not null")
    rows = rows.withColumn("call_id", F.coalesce(_at("block", "$.tool_use_id"), _at("block", "$.id")))
    rows = rows.withColumn("tool_name", F.when(F.col("role") == "tool_call", F.coalesce(nonempty(_at("block", "$.name")), F.lit("unknown"))))
    text = (
        F.when(F.col("role") == "tool_call", indented_json(F.coalesce(_value("block", "$.input"), F.lit("{}"))))
        .when(F.col("role") == "tool_result", result)
        .when(F.col("role") == "thinking", _at("block", "$.thinking"))
        .otherwise(_at("block", "$.text"))
    )
    rows = rows.withColumn("text", text).withColumn("raw", F.col("block")).where("role in ('tool_call', 'tool_result') or coalesce(text, '') <> ''")
    return _numbered(_named_results(rows), "seq", "line_no", "block_no").select(*_ENTRY)


def claude_sessions(lines: DataFrame) -> DataFrame:
    """Per file: the first session id, branch, directory and model, the first and last time."""
    typed = lines.where("valid").select("file_path", "line_no", "line", _time("line", "$.timestamp").alias("ts"))

    def first(path: str, only: Column | None = None) -> Column:
        value = nonempty(_at("line", path))
        value = value if only is None else F.when(only, value)
        return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))

    at = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    return typed.groupBy("file_path").agg(
        first("$.sessionId").alias("session_id"), first("$.gitBranch").alias("git_branch"), first("$.cwd").alias("cwd"),
        first("$.message.model", _at("line", "$.type") == "assistant").alias("model"),
        F.min_by("ts", at).alias("started_at"), F.max_by("ts", at).alias("ended_at"),
    )


def _joined(rows: DataFrame, part: Column, *keys: str) -> DataFrame:
    """One message per line: its parts joined by newlines in block order, with the names of its tools."""
    pieces = F.array_sort(F.collect_list(F.struct("block_no", part.alias("part"), F.col("tool").alias("tool"))))
    grouped = rows.groupBy("file_path", "line_no", *keys).agg(pieces.alias("p"))
    text = F.array_join(F.transform(F.filter("p", lambda x: F.coalesce(x["part"], F.lit("")) != ""), lambda x: x["part"]), "\n")
    tools = F.transform(F.filter("p", lambda x: x["tool"].isNotNull()), lambda x: x["tool"])
    return grouped.withColumn("text", text).withColumn("tools", tools).drop("p")


def claude_messages(lines: DataFrame) -> DataFrame:
    rows = _claude_blocks(lines)
    said = F.when(F.col("kind") == "text", F.when(F.col("type") == "assistant", F.trim(_at("block", "$.text"))).otherwise(_at("block", "$.text"))).when(
        F.col("kind").isNull() & (F.col("type") == "user"), F.col("block")
    )
    used = (F.col("type") == "assistant") & (F.col("kind") == "tool_use")
    name = F.coalesce(_at("block", "$.name"), F.lit("unknown"))
    given = spaced_json(_something("block", "$.input"))
    rows = rows.withColumn("tool", F.when(used, name))
    part = F.when(used, F.concat(F.lit("[tool: "), name, F.lit("] "), F.left(given, F.lit(MOST_INPUT)))).otherwise(said)
    out = _joined(rows, part, "type", "ts")
    out = out.withColumn("text", F.when(F.col("type") == "user", F.trim(strip_noise(F.col("text")))).otherwise(F.col("text")))
    out = out.where("text <> '' or size(tools) > 0").withColumnRenamed("type", "role")
    return _numbered(out, "idx", "line_no").select("file_path", "idx", "role", "ts", "text", "tools")


# The second tool: payloads, wrapped or inlined.

_CALLS = ("function_call", "custom_tool_call", "tool_search_call", "web_search_call")
_OUTPUTS = ("function_call_output", "custom_tool_call_output", "tool_search_output")
_TEXTS = ("input_text", "output_text", "text")
# Fixed value: what stands for reasoning of which only the encrypted form is there.
SEALED = "[reasoning content is encrypted by the model provider; not recoverable from the rollout file]"


def _codex_payloads(lines: DataFrame) -> DataFrame:
    wrapped = _at("line", "$.type") == "response_item"
    payload = F.when(wrapped, _at("line", "$.payload")).when(_at("line", "$.type").isin("message", "reasoning", *_CALLS, *_OUTPUTS), F.col("line"))
    rows = lines.where("valid").select("file_path", "line_no", F.lit(0).alias("block_no"), payload.alias("payload"), _time("line", "$.timestamp").alias("ts"))
    return rows.where("payload is not null").withColumn("kind", _at("payload", "$.type"))


def _texts_of(path: str, kinds: tuple[str, ...] | None = _TEXTS) -> Column:
    """A text, or the texts of a list's blocks of the given types (None: of all) joined by newlines."""
    parts = F.from_json(_at("payload", path), "array<struct<type:string,text:string>>")
    said = lambda b: F.coalesce(b["text"], F.lit("")) != ""
    chosen = F.filter(parts, said if kinds is None else lambda b: b["type"].isin(*kinds) & said(b))
    listed = F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")
    return F.when(_kind("payload", path) == "STRING", _at("payload", path)).otherwise(F.coalesce(listed, F.lit("")))


def codex_entries(lines: DataFrame) -> DataFrame:
    """Messages, reasoning (a placeholder where only its encrypted form is there), calls and outputs, in file order."""
    rows = _codex_payloads(lines)
    kind = F.col("kind")
    call, output = kind.isin(*_CALLS), kind.isin(*_OUTPUTS)
    role = F.when(kind == "message", F.coalesce(nonempty(_at("payload", "$.role")), F.lit("unknown"))).when(kind == "reasoning", "reasoning").when(call, "tool_call").when(output, "tool_result")
    thought = F.concat_ws("\n", nonempty(_texts_of("$.summary", None)), nonempty(_texts_of("$.content", None)))
    sealed = F.when(nonempty(_at("payload", "$.encrypted_content")).isNotNull(), SEALED).otherwise("")
    given = indented_json(F.coalesce(_something("payload", "$.input"), _something("payload", "$.action"), F.lit("{}")))
    given = F.coalesce(_at("payload", "$.arguments"), given)
    got = F.coalesce(_at("payload", "$.output"), indented_json(F.coalesce(_something("payload", "$.tools"), F.lit("{}"))))
    text = F.when(kind == "message", _texts_of("$.content")).when(kind == "reasoning", F.coalesce(nonempty(thought), sealed)).when(call, given).when(output, got)
    rows = rows.withColumn("role", role).where("role is not null")
    rows = rows.withColumn("call_id", F.coalesce(_at("payload", "$.call_id"), F.when(call, _at("payload", "$.id"))))
    rows = rows.withColumn("tool_name", F.when(call, F.coalesce(nonempty(_at("payload", "$.name")), kind)))
    rows = rows.withColumn("text", text).withColumn("raw", F.col("payload")).where("role in ('tool_call', 'tool_result') or coalesce(text, '') <> ''")
    return _numbered(_named_results(rows), "seq", "line_no").select(*_ENTRY)


def codex_session_meta(lines: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Per file: id, cwd (else the first <cwd> tag in the entries), started_at, model (of the first turn, else the provider), ended_at."""
    head = lines.where("valid and line_no = 0")
    wrapped = _at("line", "$.type") == "session_meta"
    legacy = _at("line", "$.type").isNull() & _at("line", "$.id").isNotNull() & (_at("line", "$.git").isNotNull() | _at("line", "$.instructions").isNotNull())
    head = head.withColumn("payload", F.when(wrapped, _at("line", "$.payload")).when(legacy, F.col("line")))
    head = head.select(
        "file_path", _at("payload", "$.id").alias("session_id"), _at("payload", "$.cwd").alias("cwd"),
        F.when(F.col("payload").isNotNull(), F.coalesce(_at("payload", "$.timestamp"), _at("line", "$.timestamp"))).alias("started_at"),
        _at("payload", "$.model_provider").alias("provider"),
    )
    turn = F.when(_at("line", "$.type") == "turn_context", _at("line", "$.payload.model"))
    models = lines.where("valid").groupBy("file_path").agg(F.min_by(turn, F.when(turn.isNotNull(), F.col("line_no"))).alias("model"))
    ends = _codex_payloads(lines).where("ts is not null").groupBy("file_path").agg(F.max_by("ts", "line_no").alias("ended_at"))
    out = models.join(head, "file_path", "left").join(ends, "file_path", "left")
    if entries is not None:
        tag = nonempty(F.trim(F.regexp_extract("text", r"(?s)<cwd>(.*?)</cwd>", 1)))
        tags = entries.where(F.col("text").contains("<cwd>")).groupBy("file_path").agg(F.min_by(tag, F.when(tag.isNotNull(), F.col("seq"))).alias("tag"))
        out = out.join(tags, "file_path", "left").withColumn("cwd", F.coalesce("cwd", "tag")).drop("tag")
    return out.withColumn("model", F.coalesce("model", "provider")).withColumn("ended_at", F.coalesce("ended_at", "started_at")).drop("provider")


def codex_messages(lines: DataFrame) -> DataFrame:
    rows = _codex_payloads(lines)
    said = (F.col("kind") == "message") & _at("payload", "$.role").isin("user", "assistant")
    called = F.col("kind") == "function_call"
    name = F.coalesce(nonempty(_at("payload", "$.name")), F.lit("unknown"))
    call = F.rtrim(F.concat(F.lit("[tool: "), name, F.lit("] "), F.left(F.coalesce(_at("payload", "$.arguments"), F.lit("")), F.lit(MOST_INPUT))))
    text = F.when(said, F.trim(strip_noise(_texts_of("$.content")))).when(called, call)
    rows = rows.withColumn("text", text).where("text <> ''").withColumn("role", F.when(called, "tool").otherwise(_at("payload", "$.role")))
    rows = rows.withColumn("tools", F.when(called, F.array(name)).otherwise(F.array().cast("array<string>")))
    return _numbered(rows, "idx", "line_no").select("file_path", "idx", "role", "ts", "text", "tools")


# The third tool: lines with a role and a message; a user's text holds its time and query in tags.


def _cursor_blocks(lines: DataFrame) -> DataFrame:
    rows = lines.where("valid").select("file_path", "file_mtime", "line_no", _at("line", "$.role").alias("role"), _blocks("line", "$.message.content").alias("blocks"))
    rows = rows.where(F.col("role").isin("user", "assistant"))
    rows = rows.select("file_path", "file_mtime", "line_no", "role", F.posexplode("blocks").alias("block_no", "block"))
    return rows.where(F.startswith("block", F.lit("{"))).withColumn("kind", _at("block", "$.type"))


def user_time(raw: Column) -> Column:
    return nonempty(F.trim(F.regexp_extract(raw, r"(?s)<timestamp>(.*?)</timestamp>", 1)))


def user_text(raw: Column) -> Column:
    """The query of a user's text, without its first time tag and image marks."""
    rest = F.regexp_replace(raw, r"(?s)^(.*?)<timestamp>.*?</timestamp>", "$1")
    query = F.regexp_extract(rest, r"(?s)<user_query>(.*?)</user_query>", 1)
    return F.trim(F.regexp_replace(F.trim(F.when(rest.rlike(r"(?s)<user_query>.*?</user_query>"), query).otherwise(rest)), r"\[Image(?: #[0-9]+)?\]", ""))


def _unredacted(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\n*\[REDACTED\]\s*", "\n"), r"^\s+|\s+$", ""))


def cursor_entries(lines: DataFrame) -> DataFrame:
    rows = _cursor_blocks(lines)
    raw = F.coalesce(_at("block", "$.text"), F.lit(""))
    text, called = F.col("kind") == "text", F.col("kind") == "tool_use"
    user = F.col("role") == "user"
    rows = rows.where(text | called).select(
        "file_path", "line_no", "block_no", F.when(called, "tool_call").otherwise(F.col("role")).alias("role"),
        F.when(text & user, user_time(raw)).alias("ts"), F.when(called, F.coalesce(nonempty(_at("block", "$.name")), F.lit("unknown"))).alias("tool_name"),
        F.when(called, indented_json(F.coalesce(_value("block", "$.input"), F.lit("{}")))).otherwise(_unredacted(F.when(user, user_text(raw)).otherwise(raw))).alias("text"),
        F.col("block").alias("raw"),
    )
    return _numbered(rows.where("role = 'tool_call' or text <> ''"), "seq", "line_no", "block_no").select(*_ENTRY)


def _mtime_iso() -> Column:
    return F.date_format("file_mtime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def cursor_sessions(lines: DataFrame) -> DataFrame:
    """Per file: started_at (the first time of a user, else the file's) and ended_at (the last time, else the start)."""
    rows = _cursor_blocks(lines)
    at = F.when((F.col("role") == "user") & (F.col("kind") == "text"), user_time(_at("block", "$.text")))
    rows = rows.withColumn("at", at).withColumn("place", F.when(at.isNotNull(), F.struct("line_no", "block_no")))
    out = rows.groupBy("file_path", "file_mtime").agg(F.min_by("at", "place").alias("first"), F.max_by("at", "place").alias("last"))
    return out.select("file_path", F.coalesce("first", _mtime_iso()).alias("started_at"), F.coalesce("last", "first", _mtime_iso()).alias("ended_at"))


def cursor_messages(lines: DataFrame) -> DataFrame:
    """Messages with tools; ``first_ts`` is the session's first time that can be read, else the file's."""
    rows = _cursor_blocks(lines)
    rows = rows.withColumn("tool", F.when(F.col("kind") == "tool_use", F.coalesce(nonempty(_at("block", "$.name")), F.lit("unknown"))))
    part = F.when(F.col("kind") == "text", _unredacted(F.trim(F.coalesce(_at("block", "$.text"), F.lit("")))))
    out = _joined(rows, part, "role", "file_mtime")
    user = F.col("role") == "user"
    out = out.withColumn("ts", F.when(user, user_time(F.col("text"))))
    out = out.withColumn("text", F.trim(strip_noise(F.when(user, user_text(F.col("text"))).otherwise(F.col("text"))))).where("text <> '' or size(tools) > 0")
    every = Window.partitionBy("file_path")
    first = F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line_no"))).over(every)
    out = out.withColumn("first", first).withColumn("first_ts", F.when(sort_ts(F.col("first")) > 0, F.col("first")).otherwise(_mtime_iso()))
    return _numbered(out, "idx", "line_no").select("file_path", "idx", "role", "ts", "text", "tools", "first_ts")
