import json


from sessionlake.plans import catalog, catalog_sources  # noqa: F401
from sessionlake.sources import stores
from sessionlake.sources import transcripts as S


def write(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")


def entries(df):
    return [(r.role, r.tool_name, r.text) for r in df.orderBy("file_path", "seq").collect()]


def test_claude(spark, tmp_path):
    write(
        tmp_path / "p/a.jsonl",
        {"type": "user", "sessionId": "s1", "cwd": "/w", "gitBranch": "main", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hello <system-reminder>x</system-reminder>"}},
        "not json", "",
        {"type": "assistant", "timestamp": 1767225600500, "message": {"model": "m1", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok é"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"cmd": "ls", "n": [1]}}]}},
        {"type": "user", "timestamp": "2026-01-01T00:00:02Z", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "tool_result", "tool_use_id": "t2", "content": "raw"}]}},
        {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "t2", "name": "Late", "input": {}}]}},
    )
    lines = S.read_raw_lines(spark, str(tmp_path))
    assert lines.where("not valid").count() == 1
    got = entries(S.claude_entries(lines))
    assert got == [
        ("user", None, "hello <system-reminder>x</system-reminder>"), ("thinking", None, "hm"), ("assistant", None, "ok é"),
        ("tool_call", "Bash", json.dumps({"cmd": "ls", "n": [1]}, indent=2)), ("tool_result", "Bash", "a\nb"), ("tool_result", None, "raw"), ("tool_call", "Late", "{}"),
    ]
    s = S.claude_sessions(lines).first()
    assert (s.session_id, s.git_branch, s.cwd, s.model, s.started_at, s.ended_at) == ("s1", "main", "/w", "m1", "2026-01-01T00:00:00Z", "2026-01-01T00:00:02Z")
    assert [r.ts for r in S.claude_entries(lines).where("role = 'thinking'").collect()] == ["2026-01-01T00:00:00.500000+00:00"]
    m = S.claude_messages(lines).orderBy("idx").collect()
    assert [(r.role, r.text, r.tools) for r in m] == [("user", "hello", []), ("assistant", 'ok é\n[tool: Bash] {"cmd": "ls", "n": [1]}', ["Bash"]), ("assistant", "", ["Late"])]


def test_codex(spark, tmp_path):
    write(
        tmp_path / "rollout-1.jsonl",
        {"type": "session_meta", "timestamp": "t0", "payload": {"id": "c1", "timestamp": "t0", "model_provider": "prov"}},
        {"type": "turn_context", "payload": {"model": "m2"}},
        {"type": "response_item", "timestamp": "t1", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<cwd>/w/x</cwd> hi"}]}},
        {"type": "response_item", "timestamp": "t2", "payload": {"type": "reasoning", "summary": [{"type": "summary_text", "text": "why"}]}},
        {"type": "response_item", "timestamp": "t3", "payload": {"type": "reasoning", "encrypted_content": "zzz"}},
        {"type": "response_item", "timestamp": "t4", "payload": {"type": "function_call", "name": "sh", "call_id": "k", "arguments": "{\"a\":1}"}},
        {"type": "response_item", "timestamp": "t5", "payload": {"type": "function_call_output", "call_id": "k", "output": "done"}},
    )
    write(tmp_path / "rollout-2.jsonl", {"id": "old", "timestamp": "t9", "git": {}}, {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "old style"}]})
    lines = S.read_raw_lines(spark, str(tmp_path))
    e = S.codex_entries(lines)
    assert entries(e) == [
        ("user", None, "<cwd>/w/x</cwd> hi"), ("reasoning", None, "why"), ("reasoning", None, S.SEALED), ("tool_call", "sh", '{"a":1}'), ("tool_result", "sh", "done"),
        ("assistant", None, "old style"),
    ]
    meta = {r.session_id: r for r in S.codex_session_meta(lines, e).collect()}
    assert (meta["c1"].cwd, meta["c1"].model, meta["c1"].ended_at) == ("/w/x", "m2", "t5") and meta["old"].started_at == "t9"
    m = S.codex_messages(lines).orderBy("file_path", "idx").collect()
    assert [(r.role, r.text) for r in m] == [("user", "<cwd>/w/x</cwd> hi"), ("tool", '[tool: sh] {"a":1}'), ("assistant", "old style")]


def test_cursor(spark, tmp_path):
    write(
        tmp_path / "x/agent-transcripts/u1/u1.jsonl",
        {"role": "user", "message": {"content": [{"type": "text", "text": "<timestamp>Friday, Jul 10, 2026, 11:59 AM (UTC-7)</timestamp><user_query>do [Image #1] it</user_query>"}]}},
        {"role": "assistant", "message": {"content": [{"type": "text", "text": "yes\n[REDACTED] more"}, {"type": "tool_use", "name": "Edit", "input": {"p": 1}}]}},
    )
    lines = S.read_raw_lines(spark, str(tmp_path))
    assert entries(S.cursor_entries(lines)) == [("user", None, "do  it"), ("assistant", None, "yes\nmore"), ("tool_call", "Edit", '{\n  "p": 1\n}')]
    assert S.cursor_sessions(lines).first().started_at == "Friday, Jul 10, 2026, 11:59 AM (UTC-7)"
    m = S.cursor_messages(lines).orderBy("idx").collect()
    assert [(r.role, r.text, r.tools) for r in m] == [("user", "do  it", []), ("assistant", "yes\nmore", ["Edit"])]


def test_paths(spark):
    rows = [("/h/p/u/subagents/s.jsonl",), ("/h/p/u.jsonl",), ("/h/p/journal.jsonl",), ("/c/archived_sessions/rollout-1.jsonl",), ("/x/agent-transcripts/u/u.jsonl",), ("/x/notes.txt",)]
    got = S.classify_transcript_paths(spark.createDataFrame(rows, "file_path string")).orderBy("file_path").collect()
    assert sorted((r.source, r.is_subagent, r.is_archived, r.session_stem) for r in got) == [
        ("claude", False, False, "u"), ("claude", True, False, "u/subagent/s"), ("codex", False, True, "rollout-1"), ("cursor", False, False, "u"),
    ]


def test_composer(spark):
    bubble = {"type": 2, "thinking": {"text": "t"}, "toolFormerData": {"name": "grep", "rawArgs": "{}", "result": "r"}, "text": "a"}
    rows = [
        ("composerData:c1", json.dumps({"name": "Title", "fullConversationHeadersOnly": [{"bubbleId": "b2"}, {"bubbleId": "none"}, {"bubbleId": "b1"}]})),
        ("bubbleId:c1:b1", json.dumps({"type": 1, "text": "hi"})), ("bubbleId:c1:b2", json.dumps(bubble)),
        ("composerData:c2", json.dumps({"conversation": [{"type": 1, "text": "inline"}]})), ("composerData:c3", json.dumps({"name": "empty"})),
    ]
    got = stores.composer_entries(spark.createDataFrame(rows, "key string, value string")).orderBy("composer_id", "seq").collect()
    assert [(r.composer_id, r.role, r.tool_name, r.text) for r in got] == [
        ("c1", "user", None, "[chat title] Title"), ("c1", "thinking", None, "t"), ("c1", "tool_call", "grep", "{}"), ("c1", "tool_result", "grep", "r"),
        ("c1", "assistant", None, "a"), ("c1", "user", None, "hi"), ("c2", "user", None, "inline"),
    ]
    ws = spark.createDataFrame([("w1", json.dumps({"allComposers": [{"composerId": "c1"}]})), ("w2", json.dumps({"allComposers": [{"composerId": "c1"}, {"composerId": "c2"}]}))], "workspace string, value string")
    folders = spark.createDataFrame([("w1", "file:///a"), ("w2", "file:///b")], "workspace string, folder string")
    assert sorted(map(tuple, stores.composer_workspaces(ws, folders).collect())) == [("c1", "/a"), ("c2", "/b")]


def test_blob_timeline(spark):
    edges = [("a", None, 8, 1, "t2"), ("a", None, 8, 0, "t1"), ("a", "t1", 1, 0, "m1"), ("a", "t1", 1, 1, "m2"), ("a", "t2", 1, 0, "m2"), ("a", "t2", 1, 1, "m3"), ("b", None, 1, 0, "x2"), ("b", None, 6, 1, "x1")]
    leaves = [("a", m, i, False, False) for i, m in enumerate(("m3", "m2", "m1"))] + [("b", m, i, False, False) for i, m in enumerate(("x1", "x2"))]
    leaves += [("c", "y1", 0, False, False), ("c", "y2", 1, True, False), ("c", "y3", 2, False, False), ("c", "root", 3, False, True)]
    got = stores.order_blob_timeline(
        spark.createDataFrame(edges, "chat_id string, parent string, field_no int, pos int, child string"),
        spark.createDataFrame(leaves, "chat_id string, blob_id string, insert_pos int, references_other boolean, is_root boolean"),
    )
    assert [(r.chat_id, r.blob_id, r.tier) for r in got.orderBy("chat_id", "seq").collect()] == [
        ("a", "m1", 1), ("a", "m2", 1), ("a", "m3", 1), ("b", "x2", 2), ("b", "x1", 2), ("c", "y1", 3), ("c", "y3", 3),
    ]
    blobs = spark.createDataFrame([("1", '{"role":"user","content":"hi"}'), ("2", '{"role":"tool","content":["a",{"text":"b"},{"x":1}]}'), ("3", '{"role":"other"}'), ("4", "junk")], "blob_id string, body string")
    assert sorted(map(tuple, stores.role_content_rows(blobs).collect())) == [("1", "user", "hi"), ("2", "tool", "a\nb")]


def capture(seq, method, direction="server_to_client", **params):
    return json.dumps({"type": "rpc", "captured_at": f"2026-01-01T00:00:{seq:02d}Z", "sequence": seq, "direction": direction, "message": {"method": method, "params": params}})


CAPTURE = [
    json.dumps({"type": "sidechat_meta", "thread_id": "th", "parent_thread_id": "pa", "cwd": "/w", "model": "m", "captured_at": "2026-01-01T00:00:00Z"}),
    capture(1, "turn/start", "client_to_server", input=[{"type": "text", "text": "ask"}]),
    capture(2, "item/agentMessage/delta", itemId="i1", delta="par"), capture(3, "item/agentMessage/delta", itemId="i1", delta="tial"),
    capture(4, "item/agentMessage/delta", itemId="i2", delta="lost"),
    capture(5, "item/completed", item={"id": "i2", "type": "agentMessage", "text": "whole"}), "broken",
]


def test_captures(spark):
    lines = spark.createDataFrame([("th", i, x) for i, x in enumerate(CAPTURE, 1)], "thread string, line_no int, line string")
    got = stores.captured_chat_messages(lines).orderBy("idx").collect()
    assert [(r.role, r.text) for r in got] == [("user", "ask"), ("assistant", "partial"), ("assistant", "whole")]
    c = stores.captured_chats(lines).first()
    assert (c.parent_id, c.cwd, c.model, c.last_ts - c.first_ts) == ("pa", "/w", "m", 5.0)


def test_fallback_and_merge(spark):
    chats = spark.createDataFrame([("th", ["first", "logged"])], "thread string, prompts array<string>")
    logs = spark.createDataFrame(
        [(7, 100, 0, "th", "core::session::handlers", 'UserInput { items: [Text { text: "logged", text_elements: [] }] }'), (8, 101, 500000000, "th", "core::stream_events_utils", "x:handle_output_item_done: ToolCall: shell {\"a\": 1} \n thread_id=th")],
        "id long, ts long, ts_nanos long, thread string, target string, body string",
    )
    f = stores.fallback_chat_messages(chats, logs)
    assert [(r.role, r.text, r.ts) for r in f.orderBy("idx").collect()] == [("user", "first", 100.0), ("user", "logged", 100.0), ("tool", '[tool: shell] {"a": 1}', 101.5)]
    mine = spark.createDataFrame([("th", 0, "user", 99.0, "logged"), ("th", 1, "assistant", None, "end")], "thread string, idx int, role string, ts double, text string")
    merged = stores.merge_chat_copies(mine, f).orderBy("idx").collect()
    assert [r.text for r in merged] == ["logged", "first", '[tool: shell] {"a": 1}', "end"]
    a = spark.createDataFrame([("x", None, "/c", ["p", "q"])], "thread string, parent_id string, cwd string, prompts array<string>")
    b = spark.createDataFrame([("x", "pp", "/d", ["q", "r"]), ("y", None, None, ["z"])], "thread string, parent_id string, cwd string, prompts array<string>")
    assert sorted(map(tuple, stores.merge_chats(a, b).collect())) == [("x", "pp", "/c", ["p", "q", "r"]), ("y", None, None, ["z"])]


def test_prompts_and_markers(spark):
    claude = spark.createDataFrame([("do it", "/p", 2000)], "display string, project string, timestamp long")
    codex = spark.createDataFrame([("ask", "s", 5)], "text string, session_id string, ts long")
    sessions = spark.createDataFrame([("s", "/c")], "session_id string, cwd string")
    cursor = spark.createDataFrame([("/x/u.jsonl", 0, "user", "first", "9"), ("/x/u.jsonl", 2, "user", "second", "9")], "file_path string, idx int, role string, text string, first_ts string")
    got = sorted(map(tuple, stores.prompt_log(claude, codex, sessions, cursor).collect()))
    assert got == [("claude", 2.0, None, "/p", "do it"), ("codex", 5.0, "s", "/c", "ask"), ("cursor", 9.0, "u", None, "first")]
    files = spark.createDataFrame([(json.dumps({"records": [{"imported_thread_id": "t", "source_path": "a", "imported_at": "1"}, {"imported_thread_id": "t", "source_path": "b", "imported_at": "2"}, {"x": 1}]}),)], "value string")
    assert list(map(tuple, stores.import_markers(files).collect())) == [("t", "b", "2")]


def _conversations(spark, tmp_path, n):
    spark.range(n).selectExpr("id conv_id", "0L turn", "'user' role", "concat('t', id) text").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path)


def test_workspaces_are_bounded(spark, tmp_path, monkeypatch):
    seen, real = [], stores.composer_workspaces
    monkeypatch.setattr(stores, "composer_workspaces", lambda kv, f: seen.append(kv) or real(kv, f))
    out = catalog.QUERIES["composer_workspaces"](spark, _conversations(spark, tmp_path, 1000))
    assert {(r.composer_id, r.folder) for r in out.collect()} == {(str(i), "/w0") for i in range(1000)}
    assert seen[0].count() == 10 and seen[0].selectExpr("max(length(value)) n").first().n < 100 * 30


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """A file that is read in many splits; only line feeds end lines, and blank ones count but aren't returned."""
    rows = [f'{{"n": {i}, "x": "{"y" * (i % 90)}"}}' if i % 7 else "" for i in range(3000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\r\n".join(rows) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = S.read_raw_lines(spark, str(tmp_path))
        got = sorted((r.file_path[-7:], r.line_no, r.line, r.valid) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(f"{name}.jsonl", i, row, True) for name in "ab" for i, row in enumerate(rows) if row]


def test_inputs_of_every_type(spark, tmp_path):
    inputs = [{"a": [1, "é"]}, [], ["x", 2], "*** Begin Patch\n\"q\" \x1f é", "", 0, 1.5, True, False, None]
    calls = [{"type": "tool_use", "name": "T", "input": v} for v in inputs] + [{"type": "tool_use", "name": "T"}]
    write(tmp_path / "p/a.jsonl", {"type": "assistant", "message": {"content": calls}}, "{broken", {"type": "assistant", "message": {"content": [{"type": "text", "text": "after"}]}})
    write(tmp_path / "agent-transcripts/c.jsonl", "[1", {"role": "assistant", "message": {"content": calls}})
    write(tmp_path / "rollout-1.jsonl", *[{"type": "response_item", "payload": {"type": "custom_tool_call", "name": "T", "input": v}} for v in inputs], {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "T", "action": "go"}}, "nope")
    shown = lambda v: json.dumps(v, indent=2, ensure_ascii=False)
    want = [("tool_call", "T", shown(v)) for v in [*inputs, {}]]
    read = lambda p: S.read_raw_lines(spark, str(tmp_path / p))
    assert entries(S.claude_entries(read("p"))) == [*want, ("assistant", None, "after")]
    assert entries(S.cursor_entries(read("agent-transcripts"))) == want
    assert entries(S.codex_entries(read("rollout-1.jsonl"))) == [("tool_call", "T", shown(v or {})) for v in inputs] + [("tool_call", "T", '"go"')]
    said = S.claude_messages(read("p")).orderBy("idx").first().text
    assert said == "\n".join(f"[tool: T] {json.dumps(v)}" for v in inputs if v)


def test_results_take_the_last_call_before_them(spark):
    """One id used over and over: each result has the name of the last call before it, in one sorted sweep."""
    import time

    n = 3000
    rows = [("f", 2 * i, 0, role, "same", name) for i in range(n) for role, name in [("tool_call", f"call{i}")]] + [("f", 2 * i + 1, 0, "tool_result", "same", None) for i in range(n)]
    rows += [("f", -1, 0, "tool_result", "same", "own"), ("f", 9000, 0, "tool_result", None, "own"), ("f", 9001, 0, "user", None, None), ("g", 5, 0, "tool_result", "same", None)]
    df = spark.createDataFrame(rows, "file_path string, line_no int, block_no int, role string, call_id string, tool_name string")
    began = time.time()
    got = {(r.file_path, r.line_no): r.tool_name for r in S._named_results(df).collect()}
    assert time.time() - began < 15 and len(got) == len(rows)
    assert all(got["f", 2 * i + 1] == f"call{i}" == got["f", 2 * i] for i in range(n))
    assert got["f", -1] is None and got["f", 9000] is None and got["g", 5] is None


def test_old_files_are_not_opened(spark, tmp_path):
    import os
    from datetime import UTC, datetime

    import pytest

    (tmp_path / "new.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "old.jsonl.gz").write_bytes(b"not gzip")  # to open it is an error
    edge = datetime(2024, 1, 1, tzinfo=UTC)
    os.utime(tmp_path / "new.jsonl", (edge.timestamp(), edge.timestamp()))
    os.utime(tmp_path / "old.jsonl.gz", (edge.timestamp() - 1, edge.timestamp() - 1))
    rows = S.read_raw_lines(spark, str(tmp_path), since=edge).collect()
    assert sorted((r.line_no, r.line) for r in rows) == [(0, '{"a": 1}'), (2, '{"a": 2}')]
    with pytest.raises(Exception, match="FAILED_READ_FILE|old.jsonl.gz"):
        S.read_raw_lines(spark, str(tmp_path)).collect()
