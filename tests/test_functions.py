import hashlib
import json
import random
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import functions as F

from sessionlake.functions import text as T
from sessionlake.functions.porter import stem
from sessionlake.operators import ingest


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, column, *values_):
    names = "abcdefgh"[: len(values_)]
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'double'}" for n, v in zip(names, values_, strict=True))
    return spark.createDataFrame([values_], schema).select(column.alias("x")).first()[0]


def test_sort_ts(spark):
    cases = {
        None: 0.0, "": 0.0, "junk": 0.0, "1700000000": 1.7e9, "1700000000123": 1700000000.123,
        "2026-07-10T11:59:00Z": datetime(2026, 7, 10, 11, 59, tzinfo=UTC).timestamp(),
        "2026-07-10T11:59:00": datetime(2026, 7, 10, 11, 59, tzinfo=UTC).timestamp(),
        "2026-07-10T11:59:00.500+02:00": datetime(2026, 7, 10, 9, 59, 0, 500000, tzinfo=UTC).timestamp(),
        "Friday, Jul 10, 2026, 11:59 AM (UTC-7)": datetime(2026, 7, 10, 18, 59, tzinfo=UTC).timestamp(),
        "Friday, Jul 10, 2026, 11:59 PM (UTC+5:30)": datetime(2026, 7, 10, 18, 29, tzinfo=UTC).timestamp(),
        "Fri, Jul 10, 2026, 1:05 PM": datetime(2026, 7, 10, 13, 5, tzinfo=UTC).timestamp(),
        "2026-07-10": datetime(2026, 7, 10, tzinfo=UTC).timestamp(),
    }
    got = values(spark, [(k,) for k in cases], "a string", T.sort_ts(F.col("a")))
    assert [g[0] for g in got] == list(cases.values())


def test_display_and_file_times(spark):
    rows = [("2026-07-10T11:59:00Z",), ("",), (None,), ("not a time at all",)]
    got = values(spark, rows, "a string", T.display_ts(F.col("a")), T.file_timestamp(F.col("a")))
    assert got == [("2026-07-10 11:59", "20260710-1159"), ("", "unknown-time"), ("", "unknown-time"), ("not a time at al", "unknown-time")]


def test_uuid7(spark):
    got = values(spark, [("0190a1b2-c3d4-7abc-8def-0123456789ab",), (str(uuid.UUID(int=5)),), (None,)], "a string", T.uuid7_ts(F.col("a")))
    assert got == [(0x0190A1B2C3D4,), (None,), (None,)]


def test_text(spark):
    a = F.col("a")
    assert one(spark, T.strip_noise(a), "x<system-reminder>a\nb</system-reminder>y<command-name>z</command-name>") == "xy"
    assert one(spark, T.truncate_hit(a, 3), "abcd") == "abc\n…[truncated]"
    assert one(spark, T.truncate_block(a, 3), "abcd") == "abc... [truncated, 4 chars total]"
    assert one(spark, T.highlight(a, ["nat", "NAT x", "a.b"]), "Nat NAT x a.b aXb") == ">>>Nat<<< >>>NAT x<<< >>>a.b<<< aXb"
    assert one(spark, T.sanitize(a), "a\x00b\tc\x7f\n\x1f") == "ab\tc\n"
    assert one(spark, T.slug(a), "--A b//C!") == "a-b-c" and one(spark, T.slug(a), "!!") == "unknown" and one(spark, T.slug(a), None) == "unknown"
    header = spark.range(1).select(T.entry_header(F.lit(7), F.lit("user"), F.lit(None).cast("string"), F.lit("2026"))).first()[0]
    assert header == "### [0007] role=user ts=2026"


def test_smart_case(spark):
    rows = [("The NAT box",), ("pagination",), ("123",)]
    got = values(spark, rows, "a string", T.contains_term(F.col("a"), "nat"), T.contains_term(F.col("a"), "NAT"), T.contains_term(F.col("a"), "123"))
    assert got == [(True, True, False), (True, False, False), (False, False, True)]
    assert one(spark, T.matches_all(F.col("a"), []), "x") is False
    assert one(spark, T.matches_any(F.col("a"), ["q", "x"]), "x") is True


def test_repositories(spark):
    cases = {
        "git@github.com:Acme/Repo.git": "github.com/acme/repo", "https://user@GitHub.com:443/Acme/Repo.git": "github.com/acme/repo",
        "ssh://git@host.org/a/b/c": "host.org/a/b/c", "https://github.com/only": None, "": None, "nothing": None,
    }
    assert [g[0] for g in values(spark, [(k,) for k in cases], "a string", T.repository_slug(F.col("a")))] == list(cases.values())
    chosen = {"Acme/Repo": "github.com/acme/repo", "gitlab.com/a/b/c": "gitlab.com/a/b/c"}
    assert [g[0] for g in values(spark, [(k,) for k in chosen], "a string", T.repository_selector(F.col("a")))] == list(chosen.values())


def test_paths(spark):
    a = F.col("a")
    assert one(spark, T.path_tail(a), "/a/b/c/") == "b/c" and one(spark, T.path_tail(a), "") == "?" and one(spark, T.path_tail(a), None) == "?"
    assert one(spark, T.path_under(a, F.lit("/a/b/")), "/a/b/c") and not one(spark, T.path_under(a, F.lit("/a/b")), "/a/bc")
    assert one(spark, T.legacy_fallback(a, F.lit("u/1")), "d/claude__x__20260101-0000__s.entries.ndjson.zst") == "claude__x"
    assert one(spark, T.legacy_fallback(a, F.lit("u/1")), "d/x.md") == "u__1"
    assert one(spark, T.archive_id(F.lit("claude"), a, F.lit("s/1")), "My File") == "s__1__source-my-file"
    assert one(spark, T.person_label(a), "A.b--C@x.org") == "a-b-c"


def test_canonical_json(spark):
    for text in ['a"b\\c', "tab\tnl\nctl\x1f\x0b", "é漢😀", "\\u001F stays", "/x\x7f"]:
        want = hashlib.sha256(json.dumps({"fallback": "f", "source": text, "started_at": None, "uuid": "u"}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        got = one(spark, T.session_key(F.col("a"), F.lit("u"), F.lit(None).cast("string"), F.lit("f")), text)
        assert got == want, text


def test_redaction(spark):
    def redact(name, arguments):
        return one(spark, T.redact_arguments(F.lit(name), F.col("a")), json.dumps(arguments))

    got = json.loads(redact("search", {"query": "secret words", "person": "p" * 300, "limit": 3, "roles": ["a", "b"], "other": 1}))
    assert got == {"queryChars": 12, "querySha256": hashlib.sha256(b"secret words").hexdigest(), "person": "p" * 200, "limit": 3, "roleCount": 2}
    assert json.loads(redact("plan_upload", {"sessionFingerprints": ["a", "b", "c"]})) == {"sessionFingerprintCount": 3}
    assert json.loads(redact("missing_blobs", {"blobHashes": []})) == {"blobHashCount": 0}
    assert json.loads(redact("mystery", {"b": 1, "a": {"x": 1}})) == {"argumentNames": ["a", "b"]}
    big = json.loads(redact("mystery", {f"{i:04d}" + "k" * 190: 1 for i in range(60)}))
    assert big["omitted"] is True and big["jsonBytes"] > 8192
    assert one(spark, T.redact_arguments(F.lit("search"), F.col("a")), "[1]") is None
    # exact texts: compact, ASCII, nulls where a field is always written
    exact = {
        ("prepare_upload", '{"scope": {"repositories": ["é😀"], "until": "u", "api_key": "secret"}, "archiveBytes": "7"}'): {"archiveSha256": None, "archiveBytes": "7", "scope": {"repositories": ["é😀"], "sources": None, "since": None, "until": "u", "sessionCount": None, "visibility": None}},
        ("prepare_upload", '{"scope": "private"}'): {"archiveSha256": None, "archiveBytes": None, "scope": None},
        ("search", '{"query": "a\\u0001\\n", "limit": "3", "includeSubagents": 1, "since": "x\\ty\\u001f\\u00e9"}'): {"queryChars": 3, "querySha256": hashlib.sha256(b"a\x01\n").hexdigest(), "since": "x\ty\x1fé", "includeSubagents": 1},
        ("search", '{"query": 5, "roles": "no", "limit": 2.0}'): {},
        ("read_session", '{"sessionId": true, "offset": null}'): {"sessionId": True},
        ("cancel_upload", '{"uploadId": 5}'): {"uploadId": None},
        ("access", "{}"): {}, ("stats", '{"since": null}'): {"since": None},
        ("admin_requests", '{"limit": {"a": [1, "x y"]}, "since": null}'): {"limit": {"a": [1, "x y"]}, "since": None},
        ("unknown", '{"é\\n": 1, "a\\"": 2}'): {"argumentNames": ['a"', "é\n"]},
    }
    for (name, arguments), want in exact.items():
        assert one(spark, T.redact_arguments(F.lit(name), F.col("a")), arguments) == json.dumps(want, separators=(",", ":")), (name, arguments)


def test_errors(spark):
    rows = [(200, '{"error": {"code": 1}}'), (200, '{"result": {"isError": true}}'), (200, "{}"), (500, "x"), (None, None)]
    got = values(spark, rows, "s int, b string", T.classify_error(F.col("s"), F.col("b")))
    assert [g[0] for g in got] == ["mcp_protocol_error", "mcp_tool_error", None, "request_failed", "request_failed"]


def test_porter():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat conditional condit rational ration triplicate triplic formative form electrical electr hopefulness hope revival reviv adoption adopt probate probat rate rate controll control roll roll deployment deploy deployed deploi"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]


def test_porter_equals_fts5():
    import sqlite3

    rnd = random.Random(1)
    parts = "a e i o u y b c d l m n r s t z ing ed eed ation ational ness ful ize izer ement ment ies sses ss logi bl at iz ll ee ß ent ion able".split()
    words = sorted({"".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5))) for _ in range(20_000)})
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    db.executemany("INSERT INTO f(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    pairs = db.execute("SELECT term, doc FROM v").fetchall()
    assert len(pairs) == len(words) and [(words[d], stem(words[d]), t) for t, d in pairs if stem(words[d]) != t] == []


def test_stems_of_lists_in_arrow(monkeypatch):
    """Null, empty and sliced lists, and null words, whatever the size of a part; what is remembered of words is bounded."""
    rows = [["things", "resting"], None, [], ["caf\u00e9s", "things", "x" * 70], ["a"], None]
    want = [None if r is None else [ingest.index_word(w) for w in r] for r in rows]
    for most in (1, 40, 1 << 20):
        monkeypatch.setattr(ingest, "MOST_STEMMED", most)
        got = ingest.stemmed(pa.array(rows, pa.list_(pa.string())))
        assert got.to_pylist() == want and got.type == pa.list_(pa.string())
        assert ingest.stemmed(pa.array(rows, pa.list_(pa.string())).slice(2, 3)).to_pylist() == want[2:5]
    assert ingest.stemmed(pa.array([], pa.list_(pa.string()))).to_pylist() == []
    assert not hasattr(stem, "cache_info") and ingest._indexed.cache_info().maxsize <= 1 << 18


def test_places_of_words_in_arrow(monkeypatch):
    """Words of each list in order with their places, also of null, empty and sliced lists, whatever the size of a part."""
    rows = [["b", "a", "b"], None, [], ["é", "z", "\U0001f600", "z", "Z"], ["b"], None]

    def plain(words):
        return None if words is None else [{"term": t, "positions": [i for i, w in enumerate(words) if w == t]} for t in sorted(set(words), key=str.encode)]

    want = list(map(plain, rows))
    for most in (1, 40, 1 << 20):
        monkeypatch.setattr(ingest, "MOST_PLACED", most)
        assert ingest.placed(pa.array(rows, pa.list_(pa.string()))).to_pylist() == want
        assert ingest.placed(pa.array(rows, pa.list_(pa.string())).slice(2, 3)).to_pylist() == want[2:5]
    assert ingest.placed(pa.array([[], None], pa.list_(pa.string()))).to_pylist() == [[], None]
    assert ingest.placed(pa.array([], pa.list_(pa.string()))).to_pylist() == []
