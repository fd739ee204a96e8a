"""Chats that tools keep in key-value stores, blob graphs, capture logs and histories, landed as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.text import nonempty, sort_ts, uuid7_ts
from sessionlake.sources.transcripts import sorted_json


def _at(c: Column | str, path: str) -> Column:
    return F.get_json_object(c, path)


def composer_entries(kv: DataFrame) -> DataFrame:
    """composer_id, seq, role, tool_name and text from kv (key, value): inline conversations, else headers joined to their bubbles.

    Bubbles that aren't stored are left out; the chat's title, if it has one and any entry, comes first.
    """
    data = kv.where(F.startswith("key", F.lit("composerData:"))).select(F.substring_index("key", ":", -1).alias("composer_id"), "value")
    inline = F.from_json(_at("value", "$.conversation"), "array<string>")
    headers = F.from_json(_at("value", "$.fullConversationHeadersOnly"), "array<struct<bubbleId:string>>")
    has_inline = F.coalesce(F.size(inline), F.lit(0)) > 0
    direct = data.where(has_inline).select("composer_id", F.posexplode(inline).alias("pos", "bubble"))
    wanted = data.where(~has_inline).select("composer_id", F.posexplode(headers).alias("pos", "h")).where("coalesce(h.bubbleId, '') <> ''")
    keyed = wanted.withColumn("key", F.concat(F.lit("bubbleId:"), "composer_id", F.lit(":"), "h.bubbleId"))
    joined = keyed.join(kv.select("key", F.col("value").alias("bubble")), "key").select("composer_id", "pos", "bubble")
    b = F.col("bubble")
    user = _at(b, "$.type") == "1"
    name = F.coalesce(nonempty(_at(b, "$.toolFormerData.name")), F.concat(F.lit("tool_"), F.coalesce(_at(b, "$.toolFormerData.tool"), F.lit("None"))))
    arguments = F.coalesce(nonempty(_at(b, "$.toolFormerData.rawArgs")), nonempty(_at(b, "$.toolFormerData.params")), F.lit(""))
    has_tool = ~user & _at(b, "$.toolFormerData").isNotNull()

    def part(role: str, text: Column, tool: Column | None = None) -> Column:
        tool = F.lit(None).cast("string") if tool is None else tool
        return F.when(text.isNotNull(), F.struct(F.lit(role).alias("role"), tool.alias("tool_name"), text.alias("text")))

    text = nonempty(_at(b, "$.text"))
    parts = F.array_compact(
        F.array(
            part("user", F.when(user, text)),
            part("thinking", F.when(~user, nonempty(_at(b, "$.thinking.text")))),
            part("tool_call", F.when(has_tool, arguments), name),
            part("tool_result", F.when(has_tool, nonempty(_at(b, "$.toolFormerData.result"))), name),
            part("assistant", F.when(~user, text)),
        )
    )
    rows = direct.unionByName(joined).where(F.try_parse_json("bubble").isNotNull()).select("composer_id", "pos", F.posexplode(parts).alias("nth", "e")).select("composer_id", "pos", "nth", "e.*")
    titles = data.select("composer_id", nonempty(_at("value", "$.name")).alias("title")).where("title is not null").join(rows.select("composer_id").distinct(), "composer_id")
    first = titles.select("composer_id", F.lit(-1).alias("pos"), F.lit(0).alias("nth"), F.lit("user").alias("role"), F.lit(None).cast("string").alias("tool_name"), F.concat(F.lit("[chat title] "), "title").alias("text"))
    order = Window.partitionBy("composer_id").orderBy("pos", "nth")
    return rows.unionByName(first).withColumn("seq", F.row_number().over(order) - 1).select("composer_id", "seq", "role", "tool_name", "text")


def composer_workspaces(workspace_kv: DataFrame, workspace_json: DataFrame) -> DataFrame:
    """composer_id and folder from (workspace, value) and (workspace, folder): a composer's first workspace counts."""
    ids = workspace_kv.select("workspace", F.posexplode(F.from_json(_at("value", "$.allComposers"), "array<struct<composerId:string>>")).alias("pos", "c"))
    folders = workspace_json.select("workspace", F.regexp_replace("folder", "^file://", "").alias("folder"))
    rows = ids.join(folders, "workspace").select("workspace", "pos", F.col("c.composerId").alias("composer_id"), "folder").where("composer_id is not null")
    order = Window.partitionBy("composer_id").orderBy("workspace", "pos")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("composer_id", "folder")


def order_blob_timeline(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """chat_id, seq, blob_id and tier. edges: chat_id, parent (null: the root), field_no, pos, child. leaves: chat_id, blob_id,
    insert_pos, references_other, is_root.

    Tier 1 walks root field 8 to a tree node to leaves, tier 2 takes the root's fields 1 and 6, tier 3 leaves that refer to nothing, as
    inserted. A blob counts where it comes first; a chat uses the first tier that finds any.
    """
    root, inner = edges.where("parent is null"), edges.where("parent is not null")
    trees = root.where("field_no = 8").select("chat_id", F.col("pos").alias("p1"), F.col("child").alias("parent"))
    walk = trees.join(inner, ["chat_id", "parent"]).select("chat_id", F.lit(1).alias("tier"), F.struct("p1", F.col("pos").alias("p2")).alias("place"), F.col("child").alias("blob_id"))
    zero = F.lit(0).cast(dict(edges.dtypes)["pos"])
    flat = root.where("field_no in (1, 6)").select("chat_id", F.lit(2).alias("tier"), F.struct(F.col("pos").alias("p1"), zero.alias("p2")).alias("place"), F.col("child").alias("blob_id"))
    last = leaves.where("not references_other and not is_root").select("chat_id", F.lit(3).alias("tier"), F.struct(F.col("insert_pos").cast(dict(edges.dtypes)["pos"]).alias("p1"), zero.alias("p2")).alias("place"), "blob_id")
    known = leaves.select("chat_id", "blob_id").distinct()
    rows = walk.unionByName(flat).unionByName(last).join(known, ["chat_id", "blob_id"], "left_semi").groupBy("chat_id", "tier", "blob_id").agg(F.min("place").alias("place"))
    best = F.min("tier").over(Window.partitionBy("chat_id"))
    order = Window.partitionBy("chat_id").orderBy("place")
    return rows.withColumn("best", best).where("tier = best").withColumn("seq", F.row_number().over(order) - 1).select("chat_id", "seq", "blob_id", "tier")


def role_content_rows(blobs: DataFrame) -> DataFrame:
    """blob_id, role and text of JSON bodies {role, content: text or list} (column body) with one of four roles."""
    role = _at("body", "$.role")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("body"), "$.content", "variant"))
    parts = F.transform(F.from_json(_at("body", "$.content"), "array<string>"), lambda p: F.when(F.startswith(p, F.lit("{")), _at(p, "$.text")).otherwise(p))
    text = F.when(kind == "STRING", _at("body", "$.content")).when(kind.startswith("ARRAY"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")).otherwise("")
    return blobs.where(role.isin("system", "user", "assistant", "tool")).select("blob_id", role.alias("role"), text.alias("text"))


# Capture logs: JSON lines (thread, line_no, line) of types sidechat_meta and rpc.


def capture_events(lines: DataFrame) -> DataFrame:
    """thread, order, at, event (meta, user, delta, completed) and its fields, of the lines that matter."""
    order = F.coalesce(F.nullif(_at("line", "$.sequence").try_cast("long"), F.lit(0)), F.col("line_no").cast("long"))
    at = F.nullif(sort_ts(_at("line", "$.captured_at")), F.lit(0.0))
    kind, direction, method = _at("line", "$.type"), _at("line", "$.direction"), _at("line", "$.message.method")
    event = (
        F.when(kind == "sidechat_meta", "meta")
        .when((kind == "rpc") & (direction == "client_to_server") & method.isin("turn/start", "turn/steer"), "user")
        .when((kind == "rpc") & (direction == "server_to_client") & (method == "item/agentMessage/delta"), "delta")
        .when((kind == "rpc") & (direction == "server_to_client") & (method == "item/completed"), "completed")
    )
    inputs = F.from_json(_at("line", "$.message.params.input"), "array<struct<type:string,text:string>>")
    said = F.filter(inputs, lambda x: x["type"].isin("text", "input_text") & (F.coalesce(x["text"], F.lit("")) != ""))
    item = _at("line", "$.message.params.item")
    item_kind = _at(item, "$.type")
    completed = F.when(item_kind.isin("agentMessage", "plan"), F.trim(_at(item, "$.text"))).when(
        item_kind.isNotNull() & (item_kind != "userMessage"), F.concat(F.lit("[tool: "), item_kind, F.lit("] "), sorted_json(item))
    )
    text = (
        F.when(event == "user", F.trim(F.array_join(F.transform(said, lambda x: x["text"]), "\n")))
        .when(event == "delta", _at("line", "$.message.params.delta"))
        .when(event == "completed", completed)
    )
    done = _at("line", "$.message.params.completedAtMs").try_cast("double") / 1000
    return lines.where(F.try_parse_json("line").isNotNull()).select(
        "thread", order.alias("order"), at.alias("seen_at"), F.when(event == "completed", F.coalesce(done, at)).otherwise(at).alias("at"), event.alias("event"), text.alias("text"),
        F.coalesce(_at("line", "$.message.params.itemId"), _at(item, "$.id")).alias("item_id"),
        F.when(event == "user", "user").when((event == "completed") & ~item_kind.isin("agentMessage", "plan"), "tool").otherwise("assistant").alias("role"),
        F.when(event == "meta", F.col("line")).alias("meta"),
    )


def captured_chat_messages(lines: DataFrame) -> DataFrame:
    """thread, idx, role, ts and text: what users said, completed items, and unfinished items put together from their deltas."""
    events = capture_events(lines)
    whole = events.where("event in ('user', 'completed') and coalesce(text, '') <> ''").select("thread", "order", "role", "at", "text")
    deltas = events.where("event = 'delta' and item_id is not null and text is not null")
    done = events.where("event = 'completed' and item_id is not null").select("thread", "item_id").distinct()
    pieces = F.array_sort(F.collect_list(F.struct("order", "text", "at")))
    open_items = deltas.join(done, ["thread", "item_id"], "left_anti").groupBy("thread", "item_id").agg(pieces.alias("p"))
    partial = open_items.select(
        "thread", F.element_at("p", 1)["order"].alias("order"), F.lit("assistant").alias("role"), F.element_at("p", 1)["at"].alias("at"),
        F.trim(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("text"),
    ).where("text <> ''")
    order = Window.partitionBy("thread").orderBy("order", "role")
    return whole.unionByName(partial).withColumn("idx", F.row_number().over(order) - 1).select("thread", "idx", "role", F.col("at").alias("ts"), "text", "order")


def captured_chats(lines: DataFrame) -> DataFrame:
    """thread, parent_id, cwd, model, first_ts and last_ts of the chats in capture logs; the last value told counts."""
    events = capture_events(lines)

    def told(path: str) -> Column:
        value = _at("meta", path)
        return F.max_by(value, F.when(value.isNotNull(), F.col("order")))

    out = events.groupBy("thread").agg(
        told("$.parent_thread_id").alias("parent_id"), told("$.cwd").alias("cwd"), told("$.model").alias("model"),
        F.min("seen_at").alias("first_ts"), F.max("seen_at").alias("last_ts"),
    )
    return out.withColumn("first_ts", F.coalesce("first_ts", uuid7_ts(F.col("thread")) / 1000))


# What diagnostic log rows hold of user input (as a JSON text), tool calls and directories.
LOG_USER = r'(?s)Text \{ text: ("(?:\\.|[^"\\])*"), text_elements:'
LOG_TOOL = r"(?s):handle_output_item_done: ToolCall: (\S+)\s+(.*?)(?:\n thread_id=|\z)"
LOG_CWD = r"\bcwd=([^\s}:]+)"


def fallback_chat_messages(chats: DataFrame, logs: DataFrame, user: str = LOG_USER, tool: str = LOG_TOOL) -> DataFrame:
    """Messages of chats (thread, prompts array) known only from state and log rows (id, ts, ts_nanos, thread, target, body).

    A prompt that was logged isn't repeated; the others come before the log's rows, in their order.
    """
    rows = logs.join(chats.select("thread").distinct(), "thread", "left_semi").withColumn("at", F.col("ts") + F.coalesce("ts_nanos", F.lit(0)) / 1e9)
    inputs = rows.where(F.endswith("target", F.lit("session::handlers"))).select("thread", "id", "at", F.posexplode(F.regexp_extract_all("body", F.lit(user), F.lit(1))).alias("nth", "quoted"))
    said = inputs.select("thread", F.col("id").alias("order"), "nth", F.lit("user").alias("role"), "at", F.trim(_at(F.concat(F.lit('{"x":'), "quoted", F.lit("}")), "$.x")).alias("text")).where("coalesce(text, '') <> ''")
    calls = rows.where(F.endswith("target", F.lit("stream_events_utils")) & F.col("body").rlike(tool)).select(
        "thread", F.col("id").alias("order"), F.lit(0).alias("nth"), F.lit("tool").alias("role"), "at",
        F.concat(F.lit("[tool: "), F.regexp_extract("body", tool, 1), F.lit("] "), F.trim(F.regexp_extract("body", tool, 2))).alias("text"),
    )
    first = rows.groupBy("thread").agg(F.min("at").alias("first_at"))
    prompts = chats.select("thread", F.size("prompts").alias("n"), F.posexplode("prompts").alias("pos", "text")).join(said.select("thread", "text").distinct(), ["thread", "text"], "left_anti")
    prompts = prompts.join(first, "thread", "left").select("thread", (F.col("pos") - F.col("n")).cast("long").alias("order"), F.lit(0).alias("nth"), F.lit("user").alias("role"), F.col("first_at").alias("at"), "text")
    both = said.unionByName(calls).withColumn("order", F.col("order").cast("long")).unionByName(prompts)
    order = Window.partitionBy("thread").orderBy("order", "nth")
    return both.withColumn("idx", F.row_number().over(order) - 1).select("thread", "idx", "role", F.col("at").alias("ts"), "text")


def merge_chat_copies(captured: DataFrame, fallback: DataFrame) -> DataFrame:
    """thread, idx, role, ts and text of both copies (thread, idx, role, ts, text): the captured one whole, of the other what is new."""
    columns = ["thread", "idx", "role", "ts", "text"]
    mine = captured.select(*columns, F.lit(0).alias("copy"))
    new = fallback.select(*columns).join(captured.select("thread", "role", "text").distinct(), ["thread", "role", "text"], "left_anti")
    order = Window.partitionBy("thread").orderBy(F.col("ts").isNull(), "ts", "copy", "idx")
    return mine.unionByName(new.withColumn("copy", F.lit(1))).withColumn("idx", F.row_number().over(order) - 1).select(*columns)


def merge_chats(captured: DataFrame, fallback: DataFrame) -> DataFrame:
    """thread, parent_id, cwd and prompts of both: the captured copy's values first, prompts in order without repeats."""
    a = captured.select("thread", F.col("parent_id").alias("pa"), F.col("cwd").alias("ca"), F.col("prompts").alias("qa"))
    b = fallback.select("thread", F.col("parent_id").alias("pb"), F.col("cwd").alias("cb"), F.col("prompts").alias("qb"))
    none = F.array().cast("array<string>")
    prompts = F.array_distinct(F.concat(F.coalesce("qa", none), F.coalesce("qb", none)))
    return a.join(b, "thread", "full").select("thread", F.coalesce("pa", "pb").alias("parent_id"), F.coalesce("ca", "cb").alias("cwd"), prompts.alias("prompts"))


def prompt_log(claude_history: DataFrame, codex_history: DataFrame, codex_sessions: DataFrame, cursor_messages: DataFrame) -> DataFrame:
    """source, ts (epoch seconds), session, project and prompt of all tools' histories; of the third tool the first user turn of each file."""
    first = claude_history.select(F.lit("claude").alias("source"), (F.col("timestamp") / 1000).cast("double").alias("ts"), F.lit(None).cast("string").alias("session"), "project", F.col("display").alias("prompt"))
    cwds = codex_sessions.select(F.col("session_id"), F.col("cwd").alias("project"))
    second = codex_history.join(cwds, "session_id", "left").select(F.lit("codex").alias("source"), F.col("ts").cast("double").alias("ts"), F.col("session_id").alias("session"), "project", F.col("text").alias("prompt"))
    order = Window.partitionBy("file_path").orderBy("idx")
    third = cursor_messages.where("role = 'user' and text <> ''").withColumn("n", F.row_number().over(order)).where("n = 1")
    third = third.select(F.lit("cursor").alias("source"), sort_ts(F.col("first_ts")).alias("ts"), F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1).alias("session"), F.lit(None).cast("string").alias("project"), F.col("text").alias("prompt"))
    return first.unionByName(second).unionByName(third).where("coalesce(prompt, '') <> ''")


def import_markers(files: DataFrame) -> DataFrame:
    """thread_id, source_path and imported_at from JSON texts (value) of marker files; the last record of an id counts."""
    records = F.coalesce(F.from_json(_at("value", "$.records"), "array<string>"), F.from_json("value", "array<string>"))
    rows = files.select(F.posexplode(records).alias("pos", "r")).select("pos", _at("r", "$.imported_thread_id").alias("thread_id"), _at("r", "$.source_path").alias("source_path"), _at("r", "$.imported_at").alias("imported_at"))
    kept = rows.where("coalesce(thread_id, '') <> ''").groupBy("thread_id").agg(F.max_by(F.struct("source_path", "imported_at"), "pos").alias("r"))
    return kept.select("thread_id", "r.*")
