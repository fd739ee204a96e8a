"""Streams over captured protocol messages: filter, fork correlation and message assembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionlake.sources.stores import capture_events

# Server messages that are kept.
SERVER_METHODS = ("error", "item/completed", "item/started", "serverRequest/resolved", "turn/completed", "turn/started")
THREAD_ID = "^[A-Za-z0-9_-]{1,128}$"


def should_capture(direction: Column, method: Column) -> Column:
    """All client messages, replies, and server messages of the listed methods."""
    return (direction == "client_to_server") | method.isNull() | method.isin(*SERVER_METHODS) | method.startswith("thread/") | method.endswith("/requestApproval")


def filter_capture(rpc: DataFrame) -> DataFrame:
    """rpc has direction and method; works on streams and tables."""
    return rpc.where(F.coalesce(should_capture(F.col("direction"), F.col("method")), F.lit(False)))


def correlate_forks(requests: DataFrame, responses: DataFrame, late: str = "10 minutes") -> DataFrame:
    """side_thread, parent, cwd and model of each ephemeral fork: a request (connection, id, at, method, params) joined with its
    response (connection, id, at, result) that comes within ``late``, a bound of ours that also limits the state."""
    p, r = F.col("params"), F.col("result")
    forks = requests.where("method = 'thread/fork'").where((F.get_json_object(p, "$.ephemeral") == "true") & (F.get_json_object(p, "$.excludeTurns") == "true"))
    asked = forks.select(
        F.col("connection").alias("c1"), F.col("id").alias("i1"), F.col("at").alias("asked_at"),
        F.get_json_object(p, "$.threadId").alias("parent"), F.get_json_object(p, "$.cwd").alias("asked_cwd"),
    ).withWatermark("asked_at", late)
    answered = responses.select(
        F.col("connection").alias("c2"), F.col("id").alias("i2"), F.col("at").alias("answered_at"),
        F.get_json_object(r, "$.thread.id").alias("side_thread"), F.get_json_object(r, "$.cwd").alias("cwd"), F.get_json_object(r, "$.model").alias("model"),
    ).where(F.col("side_thread").rlike(THREAD_ID)).withWatermark("answered_at", late)
    same = F.expr(f"c1 = c2 and i1 = i2 and answered_at >= asked_at and answered_at <= asked_at + interval {late}")
    return asked.join(answered, same).select("side_thread", "parent", F.coalesce("cwd", "asked_cwd").alias("cwd"), "model")


MESSAGES = "thread string, order long, role string, ts double, text string, complete boolean"
_HELD = "threads array<struct<thread:string,items:array<struct<item:string,order:long,ts:double,text:string>>,done:array<string>,seen:double,due:long>>"


def capture_log_lines(logs: DataFrame) -> DataFrame:
    """thread, line_no and line of capture logs (file_path, place, line), of which each is named by its thread; a line's number is the place of its first byte."""
    return logs.select(F.regexp_extract("file_path", r"([^/]+)\.jsonl$", 1).alias("thread"), F.col("place").alias("line_no"), "line")


def _ticked(events: DataFrame, late: str) -> DataFrame:
    """Events with event_time for a watermark: each is followed by a tick, a row of its thread that has its time and nothing else.

    The event's own row has no event_time. So no line is left out as late, such as those of an old log that is found today, and time goes on all the same.
    """
    told = [f for f in events.schema if f.name != "thread"]
    event = F.struct(F.lit(None).cast("timestamp").alias("event_time"), *[F.col(f.name) for f in told])
    tick = F.struct(F.timestamp_seconds("seen_at").alias("event_time"), *[(F.lit(0) if f.name == "order" else F.lit(None)).cast(f.dataType).alias(f.name) for f in told])
    return events.select("thread", F.explode(F.array(event, tick)).alias("e")).select("thread", "e.*").withWatermark("event_time", late)


def stream_capture_messages(lines: DataFrame, idle: int = 600_000, late: str = "10 minutes", buckets: int = 2048) -> DataFrame:
    """Messages of a stream of capture lines (thread, line_no, line): what is complete at once, the deltas of an item kept until it
    completes, and unfinished text ``idle`` milliseconds after the thread's last line.

    Time is that of the lines (captured_at), ``late`` behind the newest of all threads, so a stream that is read again gives the same rows; a thread without times
    waits from the time that its last lines found. No line is left out as late. The ids of finished items are kept as long. A thread's lines of one batch are put in order
    in one task. Threads share ``buckets`` groups by a hash of their name, as a call of Python for each thread costs far more than its lines; each has its own time
    at which it is due, its group the least of them.
    """
    events = capture_events(lines).where("event in ('user', 'completed', 'delta')").select("thread", "order", "seen_at", "at", "event", "text", "item_id", "role")

    def assemble(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {name: [{i[0]: list(i) for i in items}, set(done), seen, due] for name, items, done, seen, due in state.get[0]} if state.exists else {}
        now, told, out = state.getCurrentWatermarkMs(), set(), []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts))
            told = set(rows["thread"])
            for name in told:
                held.setdefault(name, [{}, set(), None, None])
            for e in rows[rows["event"].notna()].sort_values("order", kind="stable").itertuples(index=False):
                items, done, seen, _ = thread = held[e.thread]
                if not pd.isna(e.seen_at):
                    thread[2] = float(e.seen_at) if seen is None else max(seen, float(e.seen_at))
                if e.event == "delta":
                    if isinstance(e.item_id, str) and isinstance(e.text, str) and e.item_id not in done:
                        items.setdefault(e.item_id, [e.item_id, e.order, e.at, ""])[3] += e.text
                    continue
                if e.event == "completed" and isinstance(e.item_id, str):
                    done.add(e.item_id)
                    items.pop(e.item_id, None)
                if isinstance(e.text, str) and e.text:
                    out.append((e.thread, e.order, e.role, e.at, e.text, True))
            for thread in map(held.get, told):
                thread[3] = max(now + 1, (now if thread[2] is None else int(thread[2] * 1000)) + idle)
        for name in [n for n, thread in held.items() if thread[3] < now and n not in told]:
            out += [(name, i[1], "assistant", i[2], i[3].strip(), False) for i in held.pop(name)[0].values() if i[3].strip()]
        if held:
            state.update(([(name, [tuple(i) for i in items.values()], sorted(done), seen, due) for name, (items, done, seen, due) in held.items()],))
            state.setTimeoutTimestamp(min(thread[3] for thread in held.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MESSAGES.split(", ")])

    dealt = _ticked(events, late).withColumn("bucket", F.pmod(F.xxhash64("thread"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(assemble, MESSAGES, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
