"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, last_doc) with one row per line key, written in sorted buckets: ``LineRuns`` writes it
as a bucketed table, so that the join of a batch with a run is a merge of sorted buckets and only the batch is
shuffled. ``add`` merge-anti-joins a batch with the runs: keys that no run has become the batch's own run on level 0; keys that a run
has go to a run of repeats. When a level holds ``fanout`` runs they are merged, bucket by bucket, into one run of the next level; repeats
likewise.

``frequent`` merges the repeats into the runs: the keys held by ``least_docs`` documents or more, with the largest document id that holds
them. ``drop_lines`` removes such lines everywhere but there.

Scale. Lines are reduced to 128-bit hashes and document ids before anything is shuffled, keys are counted before they are shuffled
(so a line in a third of all documents is one row per task), the join back to the documents is a sort-merge join that Spark can split
where a key is hot, and texts are shuffled once. A document's losses are gathered by its id and text hash, so that rows which share an id, or
have none, stay apart. A run's rows are as many as its distinct keys.

Defined results. A null or empty text is one empty line. All rows without an id count as one document, which never is the
largest. Repeated rows of one doc_id are one document: a line found only in those is found in one document. Texts and lines of any length are
read whole. An empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import ASCII_LOWER, by_batch, raw, remove, scratch_path, stored

BLANK = b" \t\n\x0b\x0c\r"


def key_of(line: bytes) -> bytes:
    return line.strip(BLANK).translate(ASCII_LOWER)


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def line_keys(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """doc_id, h (hash of the text), h1 and h2 of every different key of at least ``least_chars`` code points of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            rows, high, low = [], [], []
            for i, text in enumerate(raw(batch, "text")):
                if not text or len(text) < least_chars:
                    continue
                keys = {k for line in text.split(b"\n") if len(line) >= least_chars and code_points(k := key_of(line)) >= least_chars}
                for k in keys:
                    a, b = _hash(k)
                    rows.append(i)
                    high.append(a)
                    low.append(b)
            at = pa.array(rows, pa.int64())
            columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "h1", "h2"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, h1 long, h2 long")


class LineRuns:
    """Levelled sorted runs of line keys, as bucketed tables in the shared folder.

    ``batch`` tables have h1, h2, n_docs and last_doc. ``buckets`` is the number of sorted buckets of a run; it is fixed when the
    runs are begun, so give it for the size that they will reach.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.repeats: list[str] = []
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.written = 0
        self.paths: dict[str, str] = {}

    def _write(self, run: DataFrame) -> str:
        self.written += 1
        name = f"{self.name}_{self.written}"
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            run = run.repartition(self.buckets, "h1", "h2")  # else the rows are dealt by these keys already
        writer = run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        self.paths[name] = scratch_path(self.spark, name)
        writer.option("path", self.paths[name]).saveAsTable(name, format="parquet")
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.paths.pop(name))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of different keys; returns the table, until the next ``add``, of its rows whose keys no earlier run has."""
        self._compact()
        if not self.runs():
            own = self._write(batch)
        else:
            whole = self._write(batch)  # in buckets: the joins below only read
            fresh, rows = self.spark.table(whole), self.spark.table(whole)
            for name in self.runs():
                fresh = fresh.join(self._keys(name), ["h1", "h2"], "left_anti")
            own = self._write(fresh)
            self.repeats.append(self._write(rows.join(self._keys(own), ["h1", "h2"], "left_anti")))
            self._drop(whole)
        self.levels[0].append(own)
        return self.spark.table(own)

    def _keys(self, name: str) -> DataFrame:
        return self.spark.table(name).select("h1", "h2").hint("merge")

    def _merge(self, names: list[str]) -> str:
        """One run of several: pairs of sorted buckets are merged until one run is left."""
        while len(names) > 1:
            a, b = (self.spark.table(n).select("h1", "h2", *[F.col(c).alias(f"{c}_{x}") for c in ("n_docs", "last_doc")]) for n, x in zip(names[:2], "ab", strict=True))
            n_docs = F.coalesce("n_docs_a", F.lit(0)) + F.coalesce("n_docs_b", F.lit(0))
            both = a.join(b.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", n_docs.alias("n_docs"), F.greatest("last_doc_a", "last_doc_b").alias("last_doc"))
            merged = self._write(both)
            for name in names[:2]:
                self._drop(name)
            names = [*names[2:], merged]
        return names[0]

    def _compact(self) -> None:
        if len(self.repeats) >= self.fanout:
            self.repeats = [self._merge(self.repeats)]
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = self._merge(self.levels[k])
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(merged)

    def frequent(self, least_docs: int = 3) -> DataFrame:
        """h1, h2, n_docs, last_doc of the keys found in ``least_docs`` documents or more, over all batches.

        No two runs share a key, so each run takes up its repeats by merge joins and the results are only put together.
        """
        found = []
        for name in self.runs():
            run = self.spark.table(name)
            for i, repeat in enumerate(self.repeats):
                more = self.spark.table(repeat).select("h1", "h2", F.col("n_docs").alias(f"n{i}"), F.col("last_doc").alias(f"d{i}"))
                run = run.join(more.hint("merge"), ["h1", "h2"], "left")
            n = len(self.repeats)
            n_docs = sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(n)), F.col("n_docs"))
            last = F.greatest("last_doc", *[f"d{i}" for i in range(n)]) if n else F.col("last_doc")
            found.append(run.select("h1", "h2", n_docs.alias("n_docs"), last.alias("last_doc")).where(F.col("n_docs") >= least_docs))
        return reduce(DataFrame.unionByName, found)

    def drop(self) -> None:
        for name in list(self.paths):
            self._drop(name)


def summed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def counted(keys: DataFrame) -> DataFrame:
    """A batch for ``LineRuns``: every key once, with its number of documents and the largest of their ids."""
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def batch_of(doc_id, batches: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(batches))


def _with_losses(docs: DataFrame, least_chars: int, least_docs: int, batches: int, fanout: int) -> DataFrame:
    """``docs`` with a last column of the keys (h1, h2) that each row loses; null for none.

    The documents come in ``batches`` batches by a hash of their id, as they would over time.
    """
    spark = docs.sparkSession
    keys = stored(line_keys(docs, least_chars).distinct(), "line-keys")
    runs = LineRuns(spark, fanout=fanout)
    try:
        for b in range(batches):
            mine = keys.where(batch_of(F.col("doc_id"), batches) == b).select("doc_id", "h1", "h2").distinct()
            runs.add(counted(mine))
        frequent = stored(runs.frequent(least_docs), "frequent-lines")
    finally:
        runs.drop()
    # Only rows that lose lines get a row here; each has the keys of its own text at most.
    lost = "lost"
    while lost in docs.columns:
        lost += "_"
    losses = (
        keys.join(frequent.hint("merge"), ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("h1", "h2")).alias(lost))
        .withColumnsRenamed({"doc_id": f"{lost}_id", "h": f"{lost}_h"})
    )
    same = docs["doc_id"].eqNullSafe(losses[f"{lost}_id"]) & (F.xxhash64(docs["text"]) == losses[f"{lost}_h"])
    return docs.join(losses.hint("merge"), same, "left").select(*[docs[c] for c in docs.columns], losses[lost])


def _kept_lines(text: bytes | None, lost: list[dict] | None, least_chars: int) -> tuple[bytes, int, int]:
    """(the text that stays, lines before, lines dropped)."""
    lines = (text or b"").split(b"\n")
    if not lost:
        return text or b"", len(lines), 0
    gone = {(x["h1"], x["h2"]) for x in lost}
    kept = [x for x in lines if not (len(x) >= least_chars and code_points(k := key_of(x)) >= least_chars and _hash(k) in gone)]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """doc_id, kept (the text that stays), n_lines and n_dropped of every row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(parts):
            found = [_kept_lines(t, lost, least_chars) for t, lost in zip(raw(batch, "text"), batch.column(2).to_pylist(), strict=True)]
            kept, lines, dropped = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                ["doc_id", "kept", "n_lines", "n_dropped"],
            )

    joined = _with_losses(docs.select("doc_id", "text"), least_chars, least_docs, batches, fanout)
    return joined.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, kept string, n_lines long, n_dropped long")


def replace_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 3, fanout: int = 2) -> DataFrame:
    """``docs``, all columns, with the texts that stay; n_chars, if there, follows the text. A null text stays null."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(parts):
            names, columns = batch.schema.names[:-1], list(batch.columns[:-1])
            losses = batch.column(batch.num_columns - 1).to_pylist()
            texts = [t if t is None else _kept_lines(t, lost, least_chars)[0] for t, lost in zip(raw(batch, "text"), losses, strict=True)]
            at = names.index("text")
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pc.utf8_length(columns[at]).cast(columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)
    return _with_losses(docs, least_chars, least_docs, batches, fanout).mapInArrow(run, schema)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The contract by plain counting; for tests."""
    holders: dict[bytes, set[int | None]] = {}
    for k, text in docs:
        for line in (text or "").encode().split(b"\n"):
            if code_points(key_of(line)) >= 20:
                holders.setdefault(key_of(line), set()).add(k)
    out = []
    for k, text in docs:
        lines = (text or "").encode().split(b"\n")
        kept = [x for x in lines if not (len(h := holders.get(key_of(x), ())) >= 3 and k != max(h - {None}))]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out


#: The contract in DuckDB.
ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, line, i, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
