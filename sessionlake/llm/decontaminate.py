"""Benchmark decontamination by a generalised suffix automaton.

The words of all test items go into one automaton. Each document's words are then streamed through it; the automaton
state holds the longest suffix of the words read so far that occurs in any item. Where that length reaches a window
(``window`` words, or a whole item that is shorter), the words of the window are hit.

Scale. Different item texts are cut into pieces and blocks of about ``block_words`` words, so neither repeated nor long items make a block
larger. Tasks build the blocks' automata and write them to the shared folder; one at a time is broadcast. Documents are mapped once for each block; only
narrow rows of documents with hits are shuffled, and item ids are joined to the different sets of found texts.

Before a word reaches the automaton it passes a filter: word numbers by a dictionary, then a bitmap of the word pairs
that occur in items. Only runs of such pairs as long as the shortest window are walked.

Defined results. Null or empty texts have no words and are not contaminated. Null and empty items have no windows; an
item with a null id counts under the id ``""``. Repeated items count once per id. Repeated documents stay repeated. Texts of any length are
read whole. Empty tables give empty results or documents without hits. Columns whose names clash with the hits' stay as they are.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import WORD_BYTES, by_batch, raw, stored

_BITS = 22


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers, with the keys of the item texts of each window."""

    def __init__(self, items: list[tuple[bytes, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items if ws]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        self.shortest = min((min(window, len(s)) for _, s in coded), default=window)
        self._windows(coded)
        self._pairs(coded)

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if c in go[last]:
            q = go[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = go[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.go.append(moves)
        self.link.append(0)
        self.length.append(length)
        return len(self.go) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1, dict(self.go[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p != -1 and self.go[p].get(c) == q:
            self.go[p][c] = new
            p = self.link[p]
        return new

    def _windows(self, coded: list[tuple[bytes, list[int]]]) -> None:
        """full: the state of a state's last ``window`` words. ends: whole short items that end in a state, by its chain."""
        n, w = len(self.go), self.window
        self.full, self.ends_at = [-1] * n, [-1] * n
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            if self.length[v] >= w:
                self.full[v] = v if self.length[self.link[v]] < w else self.full[self.link[v]]
        self.items: dict[int, set[bytes]] = {}
        self.ends: dict[int, dict[int, set[bytes]]] = {}
        for key, seq in coded:
            v, k = 0, 0
            for c in seq:
                v, k = self.step(v, k, c)
                if k >= w:
                    self.items.setdefault(self.full[v], set()).add(key)
            if len(seq) < w:
                while self.length[self.link[v]] >= len(seq):
                    v = self.link[v]
                self.ends.setdefault(v, {}).setdefault(len(seq), set()).add(key)
        for v in order:
            self.ends_at[v] = v if v in self.ends else self.ends_at[self.link[v]] if self.link[v] > 0 else -1

    def _pairs(self, coded: list[tuple[bytes, list[int]]]) -> None:
        self.pairs = np.zeros(1 << _BITS, dtype=bool)
        for _, seq in coded:
            a = np.asarray(seq, dtype=np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b * 7919) & ((1 << _BITS) - 1)

    def step(self, v: int, k: int, c: int) -> tuple[int, int]:
        go, link, length = self.go, self.link, self.length
        while v and c not in go[v]:
            v = link[v]
            k = length[v]
        if c in go[v]:
            return go[v][c], k + 1
        return 0, 0

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[bytes]]:
        """Hit word spans (start, end exclusive; merged) and the keys of the item texts with occurring windows."""
        n = len(words)
        found: set[bytes] = set()
        if n < self.shortest or not self.vocab:
            return [], found
        codes = np.fromiter(map(self.vocab.get, words, (-1 for _ in range(n))), dtype=np.int64, count=n)
        known = codes >= 0
        if self.shortest > 1:
            ok = known[:-1] & known[1:]
            ok &= self.pairs[self._slot(codes[:-1], codes[1:])]
            edge = np.flatnonzero(np.diff(np.concatenate(([False], ok, [False])).view(np.int8)))
            starts, ends = edge[::2], edge[1::2] + 1  # words of a run of pairs
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).view(np.int8)))
            starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.shortest
        spans: list[list[int]] = []
        w, full, ends_at = self.window, self.full, self.ends_at
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            v = k = 0
            for i, c in enumerate(codes[a:b].tolist(), a):
                v, k = self.step(v, k, c)
                reach = 0
                if k >= w:
                    reach = w
                    found |= self.items[full[v]]
                u = ends_at[v]
                while u > 0:
                    for size, keys in self.ends[u].items():
                        if size <= k:
                            reach = max(reach, size)
                            found |= keys
                    u = ends_at[self.link[u]] if self.link[u] > 0 else -1
                if reach:
                    lo = i + 1 - reach
                    while spans and spans[-1][0] >= lo:
                        spans.pop()
                    if spans and spans[-1][1] >= lo:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([lo, i + 1])
        return [(a, b) for a, b in spans], found


HITS = "struct<n_words:long,spans:array<struct<start:long,end:long>>,keys:array<binary>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("keys", pa.list_(pa.binary()))])


def item_keys(items: DataFrame) -> DataFrame:
    """item_id (as text; a null one as ``""``) and key, a digest of the item's words, of every item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            words = [words_of(t) for t in raw(batch, "text")]
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary())], ["item_id", "key"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(run, "item_id string, key binary").where("key is not null").distinct()


def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """key, n (words) and words of the different item texts, cut to pieces of at most ``most`` words that share no window."""
    step = max(1, most - window + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            keys, sizes, texts = [], [], []
            for text in raw(batch, "text"):
                words = words_of(text)
                key = xxhash.xxh3_128_digest(b" ".join(words))
                for at in range(0, max(1, len(words) - window + 1), step) if words else ():
                    part = words[at : at + step + window - 1]
                    keys.append(key)
                    sizes.append(len(part))
                    texts.append(b" ".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], ["key", "n", "words"])

    return items.select("text").distinct().mapInArrow(run, "key binary, n long, words binary").distinct()


def _builder(window: int):
    def build(table):
        rows = sorted(zip(table.column("key").to_pylist(), table.column("words").to_pylist(), strict=True))
        data = pickle.dumps(SuffixAutomaton([(k, w.split()) for k, w in rows], window), 5)
        return pa.table({"block": table.column("block")[:1], "automaton": pa.array([data], pa.binary())})

    return build


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator:
    """One block's automaton after the other, pickled and broadcast. Tasks build them and write them to the shared folder."""
    pieces = stored(_pieces(items, window, block_words), "benchmark-pieces")
    blocks = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / block_words))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("key", "words"), F.lit(blocks)))
    built = stored(dealt.groupBy("block").applyInArrow(_builder(window), "block long, automaton binary"), "benchmark-automata")
    for b in range(blocks):
        rows = built.where(F.col("block") == b).collect()
        data = bytes(rows[0].automaton) if rows else pickle.dumps(SuffixAutomaton([], window), 5)
        yield items.sparkSession.sparkContext.broadcast(data)


_OWN: dict = {}


def _automaton(shared) -> SuffixAutomaton:
    """The worker process's automaton, kept from task to task."""
    if shared._path not in _OWN:
        _OWN.clear()
        _OWN[shared._path] = pickle.loads(shared.value)
    return _OWN[shared._path]


def _free_name(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted, overlapping or adjoining ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _hits(text: bytes | None, sam: SuffixAutomaton, before: dict | None) -> dict:
    """A text's hits by the automaton, together with those found ``before``."""
    words = words_of(text)
    spans, found = sam.scan(words)
    if before is not None:
        spans = _joined([*spans, *((x["start"], x["end"]) for x in before["spans"])])
        found |= set(before["keys"])
    return {"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "keys": sorted(found)}


def _scan_for_hits(docs: DataFrame, shared) -> DataFrame:
    """doc_id, h (text hash), spans and keys of the documents that one block of items hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = _automaton(shared)
        for batch in by_batch(batches):
            hits = [_hits(t, sam, None) for t in raw(batch, "text")]
            rows = pa.array([i for i, h in enumerate(hits) if h["spans"]], pa.int64())
            found = pa.array([h for h in hits if h["spans"]], _HITS)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in (0, 2)), found.field("spans"), found.field("keys")], ["doc_id", "h", "spans", "keys"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return keyed.mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, spans array<struct<start:long,end:long>>, keys array<binary>")


def _with_hits(docs: DataFrame, items: DataFrame, window: int, block_words: int) -> tuple[DataFrame, str]:
    """``docs``, all columns, with the hits of all items in a last column; and that column's name.

    Every block but the last is a pass that keeps narrow rows of the documents with hits only, before the next block is loaded; these are
    gathered by id and text hash and joined. The last block's pass carries the documents.
    """
    columns, last, found = docs.columns, None, []
    for block in _blocks(items, window, block_words):
        if last is not None:
            found.append(stored(_scan_for_hits(docs, last).distinct(), "benchmark-hits"))
            last.destroy()
        last = block
    before, name = _free_name(docs, "before"), _free_name(docs, "hits")
    if found:
        rows = reduce(DataFrame.unionByName, found).groupBy("doc_id", "h")
        both = F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("keys")).alias("keys"))
        rows = stored(rows.agg(both.alias(before)).withColumnsRenamed({"doc_id": f"{before}_id", "h": f"{before}_h"}), "benchmark-hits")
        docs = docs.join(rows, docs.doc_id.eqNullSafe(rows[f"{before}_id"]) & (F.xxhash64(docs.text) == rows[f"{before}_h"]), "left")
        docs = docs.select(*columns, before)

    gathered = bool(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = _automaton(last)
        for batch in by_batch(batches):
            known = batch.column(len(columns)).to_pylist() if gathered else [None] * batch.num_rows
            hits = [_hits(t, sam, k) for t, k in zip(raw(batch, "text"), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(hits, _HITS)], [*columns, name])

    return docs.mapInArrow(scan, ", ".join(f"`{c}` {k}" for c, k in docs.select(columns).dtypes) + f", `{name}` {HITS}"), name


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), block_words: int = 100_000
) -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit words, merged), item_ids (sorted), n_hit and contaminated.

    ``docs`` has doc_id and text, ``items`` has item_id and text; other columns are ignored. ``coverage`` is the share of hit words, as a
    fraction, from which a document is contaminated. Ids are joined to different sets of found item texts, not to documents.
    """
    hits, name = _with_hits(docs.select("doc_id", "text"), items, window, block_words)
    found = stored(hits.select("doc_id", f"{name}.*"), "contamination")
    sets = found.where(F.size("keys") > 0).select(F.col("keys").alias("set")).distinct()
    named = sets.select("set", F.explode("set").alias("key")).join(item_keys(items).hint("merge"), "key").groupBy("set")
    named = stored(named.agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")), "contamination-sets")
    some = found.join(named.hint("merge"), found["keys"] == named["set"])
    none = found.where(F.size("keys") == 0).withColumn("item_ids", F.array().cast("array<string>"))
    columns = ["doc_id", "n_words", "spans", "item_ids"]
    every = some.select(columns).unionByName(none.select(columns)).withColumn("n_hit", _total("spans"))
    return every.withColumn("contaminated", _contaminated(F.col("n_hit"), F.col("n_words"), coverage))


def _total(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _contaminated(n_hit: Column, n_words: Column, coverage: tuple[int, int]) -> Column:
    part, whole = coverage
    return (n_hit > 0) & (whole * n_hit >= part * n_words)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), block_words: int = 100_000) -> DataFrame:
    """The rows of ``docs`` (all columns) that the rule doesn't call contaminated."""
    hits, name = _with_hits(docs, items, window, block_words)
    return hits.where(~_contaminated(_total(f"{name}.spans"), F.col(f"{name}.n_words"), coverage)).select(docs.columns)


def remove_spans(
    docs: DataFrame, items: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), min_span: int = 13, block_words: int = 100_000
) -> DataFrame:
    """``docs`` (all columns) with the hit spans of at least ``min_span`` words cut out of the texts of contaminated documents.

    A cut goes from the first character of a span's first word to the last one of its last word; all else stays as it was. A null text stays null.
    """
    hits, name = _with_hits(docs, items, window, block_words)
    part, whole = coverage

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            names, columns = batch.schema.names[:-1], list(batch.columns[:-1])
            texts = raw(batch, "text")
            for i, h in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                n_hit = sum(s["end"] - s["start"] for s in h["spans"])
                long_ones = [s for s in h["spans"] if s["end"] - s["start"] >= min_span]
                if not long_ones or whole * n_hit < part * h["n_words"]:
                    continue
                form = np.frombuffer(texts[i].translate(WORD_BYTES), np.uint8) != 32
                edge = np.flatnonzero(np.diff(np.concatenate(([False], form, [False])).view(np.int8)))
                starts, ends, at, kept = edge[::2], edge[1::2], 0, []
                for s in long_ones:
                    kept.append(texts[i][at : starts[s["start"]]])
                    at = ends[s["end"] - 1]
                texts[i] = b"".join([*kept, texts[i][at:]])
            columns[names.index("text")] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return hits.mapInArrow(cut, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes))


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns."""
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 13) -> list[tuple]:
    """The contract by comparing every window with every place; for tests."""
    out = []
    coded = [(str(k), words_of((t or "").encode())) for k, t in items]
    for k, text in docs:
        words = words_of((text or "").encode())
        hit, found = set(), set()
        for key, ws in coded:
            w = min(window, len(ws))
            for j in range(len(ws) - w + 1) if ws else ():
                for i in range(len(words) - w + 1):
                    if words[i : i + w] == ws[j : j + w]:
                        hit.update(range(i, i + w))
                        found.add(key)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((k, len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return out


#: The contract in DuckDB: all windows joined with all places of their length.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(w[j:j + size - 1], ' ') AS gram FROM n),
place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size),
hit AS (SELECT p.doc_id, p.i, p.size, win.item_id FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM place) p JOIN win USING (size, gram)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
