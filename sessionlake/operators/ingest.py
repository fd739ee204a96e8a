"""Ingest: scope, validation, duplicates, generations, content addresses, references and postings.

Every function takes and returns DataFrames; corpus tables are replaced by new ones, never changed in place.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from sessionlake.functions import text as T

# Fixed limits of entry maps and bodies.
MOST_LINE, MOST_MAP, MOST_ROWS, MOST_BODY = 1 << 20, 32 << 20, 100_000, 64 << 20
POSTING_BUCKETS = 64
HOMES = 32


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % POSTING_BUCKETS


def postings_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def filter_allowed_repositories(sessions: DataFrame, allow: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(allowed, rejected with a reason). ``allow`` has a column repository; None allows all."""
    if allow is None:
        return sessions, sessions.limit(0).withColumn("reason", F.lit("repository_not_allowed"))
    keys = allow.select(F.lower("repository").alias("allowed")).distinct()
    same = F.lower(sessions.repository) == keys.allowed
    return sessions.join(keys, same, "left_semi"), sessions.join(keys, same, "left_anti").withColumn("reason", F.lit("repository_not_allowed"))


def split_missing_entries(sessions: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions with entries, sessions without any)."""
    held = entries.select("session_id").distinct()
    return sessions.join(held, "session_id", "left_semi"), sessions.join(held, "session_id", "left_anti").withColumn("reason", F.lit("missing_entries_member"))


def validate_entry_maps(entries: DataFrame) -> DataFrame:
    """session_id and violation: what makes a bundle invalid. ``entries`` has file_pos (place in its map), seq, role, header_line, body_sha256."""
    order = Window.partitionBy("session_id").orderBy("file_pos")
    line = F.octet_length(F.to_json(F.struct("seq", "role", "header_line", "body_sha256")))
    checked = entries.withColumn("before", F.lag("seq").over(order)).withColumn("size", line)
    row = F.array_compact(
        F.array(
            F.when(F.col("seq") <= F.col("before"), "sequence_not_increasing"),
            F.when(F.coalesce(F.length("body_sha256"), F.lit(0)) != 64, "bad_body_hash"),
            F.when(F.col("seq").isNull() | F.col("role").isNull() | F.col("header_line").isNull(), "missing_field"),
            F.when(F.col("size") > MOST_LINE, "line_too_long"),
        )
    )
    rows = checked.select("session_id", F.explode(row).alias("violation"))
    maps = entries.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(line + 1).alias("size"))
    whole = F.array_compact(F.array(F.when(F.col("n") > MOST_ROWS, "too_many_rows"), F.when(F.col("size") > MOST_MAP, "map_too_large")))
    return rows.unionByName(maps.select("session_id", F.explode(whole).alias("violation"))).distinct()


def entries_fingerprint(entries: DataFrame) -> DataFrame:
    """session_id and entries_json: the canonical JSON array of a session's ordered entries."""
    row = F.struct(
        F.col("seq"),
        T.canonical_json(F.struct("body_sha256", "header_line", "role", "seq", F.col("ts").alias("ts"))).alias("json"),
    )
    ordered = F.array_sort(F.collect_list(row))
    return entries.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda r: r["json"]), ",").alias("entries_json"))


def session_fingerprints(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """session_id and fingerprint: the digest of ordered entries (body_sha256, header_line, role, seq, ts), source and uuid."""
    joined = sessions.select("session_id", "source", "uuid").join(entries_fingerprint(entries), "session_id", "left")
    quoted = lambda c: F.regexp_extract(T.canonical_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    text = F.concat(
        F.lit('{"entries":['), F.coalesce("entries_json", F.lit("")), F.lit('],"source":'), quoted("source"), F.lit(',"uuid":'), quoted("uuid"), F.lit("}")
    )
    return joined.select("session_id", F.sha2(text, 256).alias("fingerprint"))


def verify_session_identity(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    """session_id and violation where the stated key or fingerprint isn't the computed one, or the key's fallback is missing."""
    computed = session_fingerprints(sessions, entries).withColumnRenamed("fingerprint", "computed")
    key = T.session_key(F.col("source"), F.col("uuid"), F.col("started_at"), F.col("session_fallback"))
    found = F.array_compact(
        F.array(
            F.when(F.coalesce("session_fallback", F.lit("")) == "", "missing_session_fallback"),
            F.when(~F.col("session_key").eqNullSafe(key), "session_key_mismatch"),
            F.when(~F.col("session_fingerprint").eqNullSafe(F.col("computed")), "session_fingerprint_mismatch"),
        )
    )
    return sessions.join(computed, "session_id").select("session_id", F.explode(found).alias("violation"))


def verify_bodies(bodies: DataFrame) -> DataFrame:
    """blob_hash and violation of bodies that are too large or not what their hash says."""
    large = F.octet_length("body") > MOST_BODY
    return bodies.select("blob_hash", F.when(large, "body_too_large").when(F.sha2("body", 256) != F.col("blob_hash"), "body_hash_mismatch").alias("violation")).where("violation is not null")


def split_duplicate_content(incoming: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new, duplicates): the same person's content that is live already or came earlier in the bundle (column arrival)."""
    key = ["person", "session_fingerprint"]
    live = current.select(*key).distinct().withColumn("live", F.lit(True))
    order = Window.partitionBy(*key).orderBy("arrival")
    marked = incoming.withColumn("nth", F.row_number().over(order)).join(live, key, "left").withColumn("again", F.col("live").isNotNull() | (F.col("nth") > 1))
    new = marked.where("not again").select(*incoming.columns)
    return new, marked.where("again").select(*incoming.columns).withColumn("reason", F.lit("duplicate_session_content"))


def generation_order() -> list[Column]:
    """Newest first: later end, any end before none, more entries; of equals the one that was there first."""
    ended = F.when(T.sort_ts(F.col("ended_at")) > 0, T.sort_ts(F.col("ended_at")))
    return [F.desc_nulls_last(ended), F.desc(F.coalesce("entry_count", F.lit(0))), F.asc("arrival")]


def latest_generation(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newest, stale) per person, source and session_key; existing sessions have the smaller arrival."""
    order = Window.partitionBy("person", "source", "session_key").orderBy(*generation_order())
    ranked = candidates.withColumn("generation", F.row_number().over(order))
    return ranked.where("generation = 1").drop("generation"), ranked.where("generation > 1").drop("generation").withColumn("reason", F.lit("stale_session_generation"))


def content_address(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with blob_hash instead of body, one row for each different body with its size)."""
    hashed = entries.withColumn("blob_hash", T.body_hash(F.col("body")))
    bodies = hashed.groupBy("blob_hash").agg(F.first("body").alias("body"), F.first(F.octet_length("body")).cast("long").alias("nbytes"))
    return hashed.drop("body"), bodies


def recount_references(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Blobs with nrefs counted anew; those that nothing refers to stay with 0."""
    counts = entries.groupBy("blob_hash").agg(F.count("*").alias("nrefs"))
    return blobs.drop("nrefs").join(counts, "blob_hash", "left").withColumn("nrefs", F.coalesce("nrefs", F.lit(0)))


def reuse_counts(entries: DataFrame, blobs_before: DataFrame) -> DataFrame:
    """created, reused and bytes_saved of one import: an entry creates a body if it is the first to bring it."""
    order = Window.partitionBy("blob_hash").orderBy("session_id", "seq")
    known = blobs_before.select("blob_hash").distinct().withColumn("known", F.lit(True))
    marked = entries.withColumn("nth", F.row_number().over(order)).join(known, "blob_hash", "left")
    new = F.col("known").isNull() & (F.col("nth") == 1)
    saved = F.when(~new, F.octet_length("body")).otherwise(0)
    return marked.agg(F.count_if(new).alias("created"), F.count_if(~new).alias("reused"), F.coalesce(F.sum(saved), F.lit(0)).cast("long").alias("bytes_saved"))


def skip_reason_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


def backfill_fingerprints(sessions: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions with missing fingerprints computed and only the lowest id of each person's content, their entries)."""
    computed = session_fingerprints(sessions, entries)
    filled = sessions.join(computed, "session_id", "left").withColumn("session_fingerprint", F.coalesce("session_fingerprint", "fingerprint")).drop("fingerprint")
    order = Window.partitionBy("person", "session_fingerprint").orderBy("session_id")
    kept = filled.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    return kept, entries.join(kept.select("session_id"), "session_id", "left_semi")


def backfill_session_keys(sessions: DataFrame) -> DataFrame:
    """Sessions with missing keys computed from their export paths; of one key the last by end (as text), entries and id stays."""
    legacy = T.session_key(F.col("source"), F.col("uuid"), F.col("started_at"), T.legacy_fallback(F.col("export_path"), F.col("uuid")))
    filled = sessions.withColumn("session_key", F.coalesce("session_key", legacy))
    order = Window.partitionBy("person", "source", "session_key").orderBy(
        F.desc(F.coalesce("ended_at", F.lit(""))), F.desc(F.coalesce("entry_count", F.lit(0))), F.desc("session_id")
    )
    return filled.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def import_ledger(imports: DataFrame, person: str, archive_sha256: str, offered: DataFrame, live: DataFrame, imported_at: str) -> DataFrame:
    """Imports with the row of one bundle written or renewed: kept counts its fingerprints that are live, skipped the others."""
    alive = live.where(F.col("person") == person).select("session_fingerprint").distinct().withColumn("alive", F.lit(True))
    counts = offered.select("session_fingerprint").join(alive, "session_fingerprint", "left").agg(
        F.count("alive").alias("sessions_kept"), F.count_if(F.col("alive").isNull()).alias("sessions_skipped")
    )
    row = counts.select(F.lit(person).alias("person"), F.lit(archive_sha256).alias("archive_sha256"), F.lit(imported_at).alias("imported_at"), "sessions_kept", "sessions_skipped")
    others = imports.where((F.col("person") != person) | (F.col("archive_sha256") != archive_sha256))
    return others.select(row.columns).unionByName(row)


@dataclass(frozen=True)
class Corpus:
    """The tables of a corpus. entries refer to blobs by hash, bodies hold the text of each hash once, postings index the bodies."""

    sessions: DataFrame
    entries: DataFrame
    blobs: DataFrame
    bodies: DataFrame
    skipped: DataFrame
    postings: DataFrame | None = None
    imports: DataFrame | None = None
    terms: DataFrame | None = None  # the directory of postings


@dataclass(frozen=True)
class Delta:
    """What one import adds: new rows, the session_ids that it replaces, and the change of each touched blob's nrefs."""

    sessions: DataFrame
    removed: DataFrame
    entries: DataFrame
    blobs: DataFrame
    bodies: DataFrame
    skipped: DataFrame
    postings: DataFrame


IMPORTS = "person string, archive_sha256 string, imported_at string, sessions_kept long, sessions_skipped long"
#: The analyzer of a corpus's own index.
ANALYZER = "porter"


class BundleRefused(ValueError):
    """A bundle that breaks a rule is refused as a whole."""


def with_defaults(sessions: DataFrame) -> DataFrame:
    """Manifest rows with what they may leave out: the repository in lower case, source ``unknown``, the uuid from the export path."""
    named = F.substring_index(F.substring_index(F.coalesce("export_path", F.lit("")), "/", -1), "__", 1)
    return sessions.withColumns({
        "repository": F.lower(F.coalesce("repository", F.lit(""))), "source": F.coalesce(T.nonempty(F.col("source")), F.lit("unknown")),
        "uuid": F.coalesce(T.nonempty(F.col("uuid")), named), "export_path": F.coalesce("export_path", F.lit("")),
    })


def bundle_violations(corpus: Corpus, sessions: DataFrame, entries: DataFrame, bodies: DataFrame, allow: DataFrame | None) -> DataFrame:
    """subject and violation: why a bundle has to be refused. Sessions that are skipped anyway aren't looked at, but all bodies are."""
    judged, _ = filter_allowed_repositories(with_defaults(sessions), allow)
    judged, _ = split_missing_entries(judged, entries)
    mine = entries.join(judged.select("session_id"), "session_id", "left_semi")
    mine = mine if "body_sha256" in mine.columns else mine.withColumn("body_sha256", F.col("blob_hash"))
    mapped = mine if "file_pos" in mine.columns else mine.withColumn("file_pos", F.col("seq"))
    named = [df.select(F.col(df.columns[0]).cast("string").alias("subject"), "violation") for df in (verify_session_identity(judged, mine), validate_entry_maps(mapped), verify_bodies(bodies))]
    needed = mine.select("blob_hash").distinct().join(bodies.select("blob_hash"), "blob_hash", "left_anti").join(corpus.blobs.select("blob_hash"), "blob_hash", "left_anti")
    absent = needed.select(F.col("blob_hash").alias("subject"), F.lit("missing_body").alias("violation"))
    return named[0].unionByName(named[1]).unionByName(named[2]).unionByName(absent)


def import_delta(
    corpus: Corpus, sessions: DataFrame, entries: DataFrame, bodies: DataFrame, person: str, allow: DataFrame | None, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> Delta:
    """What one bundle of ``person`` changes. ``keep`` may store the decisions about sessions, on which all the rest builds. Sessions of the bundle have globally new session_ids and an arrival.

    Not allowed repositories, sessions without entries, known content and stale generations are skipped; a newer generation replaces
    the live one with its entries, while bodies stay. The bundle must have no ``bundle_violations``. Of the corpus, only sessions of touched keys,
    entries of replaced sessions and the hashes of the bodies are read.
    """
    incoming = with_defaults(sessions).withColumn("person", F.lit(person)).withColumn("is_subagent", F.contains("export_path", F.lit("subagent")))
    allowed, denied = filter_allowed_repositories(incoming, allow)
    present, missing = split_missing_entries(allowed, entries)
    new, again = split_duplicate_content(present, corpus.sessions.where(F.col("person") == person))
    counts = entries.groupBy("session_id").agg(F.count("*").cast("int").alias("counted"))
    new = new.join(counts, "session_id").withColumn("entry_count", F.coalesce(F.when(F.col("entry_count") > 0, F.col("entry_count")), "counted")).drop("counted")
    columns, key = corpus.sessions.columns, ["person", "source", "session_key"]
    live = corpus.sessions.join(new.select(*key).distinct(), key, "left_semi").select(*columns, F.lit(-1).cast("long").alias("arrival"))
    ranked = latest_generation(live.unionByName(new.select(*columns, F.col("arrival").cast("long").alias("arrival"))))
    decided = keep(ranked[0].withColumn("reason", F.lit(None).cast("string")).unionByName(ranked[1]))
    newest, stale = decided.where("reason is null").drop("reason"), decided.where("reason is not null")
    kept, removed = newest.where("arrival >= 0").select(*columns), stale.where("arrival < 0").select("session_id")
    own = lambda df: [c for c in df.columns if c != "home"]  # noqa: E731  stored tables are dealt by home
    added = entries.join(kept.select("session_id"), "session_id", "left_semi").select(own(corpus.entries))
    known = corpus.bodies.select("blob_hash")  # one row for each body, so that no references are summed
    brought = lambda df: df.join(added.select("blob_hash").distinct(), "blob_hash", "left_semi").join(known, "blob_hash", "left_anti").dropDuplicates(["blob_hash"])
    fresh = brought(bodies).select(own(corpus.bodies))
    gone = corpus.entries.join(removed, "session_id", "left_semi")
    changes = added.select("blob_hash", F.lit(1).alias("n")).unionByName(gone.select("blob_hash", F.lit(-1).alias("n"))).groupBy("blob_hash").agg(F.sum("n").alias("nrefs"))
    sizes = brought(bodies.select("blob_hash", F.octet_length("body").cast("long").alias("nbytes")))  # no text is shuffled for them
    blobs = changes.join(sizes, "blob_hash", "left").select("blob_hash", "nbytes", "nrefs")
    lost = stale.where("arrival >= 0")
    why = ["export_path", "reason", "cwd"]
    skipped = denied.select(why).unionByName(missing.select(why)).unionByName(again.select(why)).unionByName(lost.join(incoming.select("session_id", F.col("cwd").alias("own_cwd")), "session_id").select("export_path", "reason", F.col("own_cwd").alias("cwd")))
    return Delta(kept, removed, added, blobs, fresh, skipped, build_postings(fresh, ANALYZER))


def summed_blobs(changes: DataFrame) -> DataFrame:
    """One row per blob of all changes: its size and its number of references."""
    return changes.groupBy("blob_hash").agg(F.max("nbytes").alias("nbytes"), F.sum("nrefs").alias("nrefs")).select("blob_hash", "nbytes", "nrefs")


def applied(corpus: Corpus, delta: Delta) -> Corpus:
    """The corpus after an import."""
    stay = lambda df: df.drop("home").join(delta.removed, "session_id", "left_anti")
    return replace(
        corpus, sessions=stay(corpus.sessions).unionByName(delta.sessions), entries=stay(corpus.entries).unionByName(delta.entries),
        blobs=summed_blobs(corpus.blobs.unionByName(delta.blobs)), bodies=corpus.bodies.drop("home").unionByName(delta.bodies),
        skipped=corpus.skipped.select("export_path", "reason", "cwd").unionByName(delta.skipped),
        postings=delta.postings if corpus.postings is None else corpus.postings.drop("home").unionByName(delta.postings), terms=None,
    )


def merge_import(corpus: Corpus, sessions: DataFrame, entries: DataFrame, bodies: DataFrame, person: str, allow: DataFrame | None) -> Corpus:
    """The corpus after one bundle of ``person``, as ``import_delta`` and ``applied`` have it."""
    return applied(corpus, import_delta(corpus, sessions, entries, bodies, person, allow))


def bundle_digest(sessions: DataFrame, entries: DataFrame, bodies: DataFrame) -> str:
    """What tells a bundle from others: every column of every row that was sent, whatever the order of rows and columns."""

    def summed(df: DataFrame) -> DataFrame:
        columns = {c: F.sha2("body", 256) if c == "body" else F.col(c) for c in sorted(df.columns)}
        each = F.sha2(F.to_json(F.struct(*[c.cast("string").alias(name) for name, c in columns.items()])), 256)
        parts = [F.sum(F.conv(F.substring(each, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]  # sums: equal rows don't cancel
        return df.agg(F.concat_ws("|", F.lit(",".join(columns)), F.count("*").cast("string"), *[x.cast("string") for x in parts]).alias("digest"))

    told = [summed(df).first()[0] for df in (sessions, entries, bodies)]
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


# Postings.


def index_word(word: str) -> str:
    """A word as the stemming index has it: without accents, stemmed."""
    from sessionlake.functions.porter import stem

    return stem("".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)))


def query_words(text: str, analyzer: str = "simple") -> list[str]:
    """The words of a query as an index of that analyzer has them."""
    words = postings_tokens(text)
    return list(map(index_word, words)) if analyzer == "porter" else words


@lru_cache(maxsize=1 << 18)
def _indexed(word: str) -> str:
    return index_word(word)


#: Text of words of which stems are taken at once, about.
MOST_STEMMED = 32 << 20


def stemmed(words: pa.ListArray) -> pa.ListArray:
    """Lists of words as lists of their stems: each different word of about ``MOST_STEMMED`` bytes is one Python string, all others stay in Arrow."""
    parts, at = [], 0
    step = max(1, int(len(words) * MOST_STEMMED / max(words.nbytes, 1)))
    while at < len(words):
        rows = words.slice(at, step)
        at += step
        coded = rows.flatten().dictionary_encode()
        stems = pa.array(list(map(_indexed, coded.dictionary.to_pylist())), pa.string())
        ends = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).cumsum()
        parts.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), stems.take(coded.indices), mask=rows.is_null()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


#: Words, in bytes, that are put in order at once, about.
MOST_PLACED = 8 << 20
_RUNS = ArrayType(StructType([StructField("term", StringType()), StructField("positions", ArrayType(IntegerType()))]))


def placed(words: pa.ListArray) -> pa.ListArray:
    """term and positions of each different word of each list, in order of the terms; lists of about ``MOST_PLACED`` bytes are sorted at once."""
    parts, at = [], 0
    step = max(1, int(len(words) * MOST_PLACED / max(words.nbytes, 1)))
    while at < len(words):
        rows = words.slice(at, step)
        at += step
        coded = rows.flatten().dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary)
        terms, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        key = np.repeat(np.arange(len(rows)) * len(order), lengths) + rank[coded.indices.to_numpy()]
        place = (np.arange(len(key)) - np.repeat(lengths.cumsum() - lengths, lengths)).astype(np.int32)
        by_key = np.argsort(key, kind="stable")  # places of one word of one list stay in order
        key, place = key[by_key], place[by_key]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        row, term = np.divmod(key[begins], max(len(order), 1))
        positions = pa.ListArray.from_arrays(pa.array(np.append(begins, len(key)), pa.int32()), pa.array(place))
        runs = pa.StructArray.from_arrays([terms.take(pa.array(term)), positions], ["term", "positions"])
        ends = np.bincount(row, minlength=len(rows)).cumsum()
        parts.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), runs, mask=rows.is_null()))
    kind = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(_RUNS)
def _runs(words: pa.Array) -> pa.Array:
    return placed(words)


@F.arrow_udf(_RUNS)
def _stem_runs(words: pa.Array) -> pa.Array:
    return placed(stemmed(words))


def words_of(body: str) -> Column:
    """The words of a text, in lower case."""
    return F.regexp_extract_all(F.lower(body), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def build_postings(bodies: DataFrame, analyzer: str = "simple") -> DataFrame:
    """bucket, term, blob_hash and positions: the words of each different body. ``porter`` folds accents and stems.

    A body's words are gathered inside its row, in Arrow batches, so nothing is shuffled. ``explode`` alone would filter by the lists first, and so
    make them in Python twice.
    """
    words = words_of("body")
    runs = _stem_runs(words) if analyzer == "porter" else _runs(words)
    rows = bodies.select("blob_hash", runs.alias("runs"))
    return rows.select("blob_hash", F.explode_outer("runs").alias("r")).where("r is not null").select(
        (F.crc32(F.col("r.term").cast("binary")) % POSTING_BUCKETS).cast("int").alias("bucket"), "r.term", "blob_hash", "r.positions"
    )


#: Words, or postings, in bytes, of which one segment of a stored index is made, about.
MOST_SEGMENT = 32 << 20
#: A row of a stored index: a term of one segment (``segment`` of the index ``origin``) with the numbers of the segment's bodies that hold it, the end of each
#: one's places, the places, and the bodies' homes as bits. In bucket -1 - home, ``term`` is the hash of the body of that number.
SEGMENTS = "bucket int, term string, origin long, segment long, homes long, numbers array<int>, ends array<int>, places array<int>"
_SEGMENTS = pa.schema([
    ("bucket", pa.int32()), ("term", pa.string()), ("origin", pa.int64()), ("segment", pa.int64()), ("homes", pa.int64()),
    ("numbers", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("places", pa.list_(pa.int32())),
])
PACKED = "bucket int, segment long, packed binary"
#: One part of a segment: term, hash of each number, number and positions of each posting.
_Postings = tuple[pa.Array, pa.Array, np.ndarray, pa.ListArray]


def _of_words(batches: Iterator[pa.RecordBatch], analyzer: str) -> Iterator[_Postings]:
    """Postings of rows of blob_hash and words, segment by segment."""
    for batch in batches:
        hashes, words = batch.columns
        step = max(1, int(len(words) * MOST_SEGMENT / max(words.nbytes, 1)))
        for at in range(0, len(words), step):
            held = words.slice(at, step)
            runs = placed(stemmed(held) if analyzer == "porter" else held)
            lengths = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
            each = runs.flatten()
            yield each.field("term"), hashes.slice(at, step), np.repeat(np.arange(len(held)), lengths), each.field("positions")


def _of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Postings]:
    """Postings of rows of term, blob_hash and positions, segment by segment."""

    def made(some: list[pa.RecordBatch]) -> _Postings:
        terms, hashes, positions = (c.combine_chunks() for c in pa.Table.from_batches(some).columns)
        coded = hashes.dictionary_encode(null_encoding="encode")
        return terms, coded.dictionary, coded.indices.to_numpy(), positions

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= MOST_SEGMENT:
            yield made(held)
            held = []
    if held:
        yield made(held)


def segment_rows(terms: pa.Array, hashes: pa.Array, numbers: np.ndarray, positions: pa.ListArray, origin: int, segment: int) -> pa.RecordBatch:
    """The rows of one segment, in order of bucket and term."""
    coded = terms.dictionary_encode()
    words = coded.dictionary
    bucket = np.fromiter(map(bucket_of, words.to_pylist()), np.int32, len(words))
    rank = np.empty(len(words), np.int64)
    rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    order = np.lexsort((rank, bucket))
    rank[order] = np.arange(len(words))
    of = rank[coded.indices.to_numpy()]
    by_term = np.argsort(of * len(hashes) + numbers, kind="stable")
    of, numbers, positions = of[by_term], numbers[by_term], positions.take(pa.array(by_term))
    begins = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
    ends = np.append(0, pc.list_value_length(positions).to_numpy(zero_copy_only=False).cumsum())
    homes = np.array([zlib.crc32((h or "").encode()) % HOMES for h in hashes.to_pylist()], np.int64)
    bits = np.left_shift(1, homes)
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
    whole = lambda n, value: np.full(n, value, np.int64)
    first = pa.record_batch([
        pa.array(bucket[order]), words.take(pa.array(order)), whole(len(order), origin), whole(len(order), segment), np.bitwise_or.reduceat(bits[numbers], begins[:-1]),
        lists(begins, numbers), lists(begins, ends[1:] - np.repeat(ends[begins[:-1]], np.diff(begins))), lists(ends[begins], positions.flatten()),
    ], schema=_SEGMENTS)
    by_home, n = np.argsort(homes, kind="stable"), len(hashes)
    named = pa.record_batch([
        pa.array((-1 - homes[by_home]).astype(np.int32)), hashes.take(pa.array(by_home)), whole(n, origin), whole(n, segment), bits[by_home],
        lists(np.arange(n + 1), by_home), lists(whole(n + 1, 0), []), lists(whole(n + 1, 0), []),
    ], schema=_SEGMENTS)
    return pa.Table.from_batches([first, named]).combine_chunks().to_batches()[0]


def _packed(parts: Iterator[_Postings], origin: int) -> Iterator[pa.RecordBatch]:
    """A compressed table for each bucket of each segment; a segment is known by its task and its place in it, which are the same if the task runs again."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << 32
    for n, (terms, hashes, numbers, positions) in enumerate(parts):
        if not len(terms):
            continue
        rows = segment_rows(terms, hashes, numbers, positions, origin, task + n)
        bucket = rows.column("bucket").to_numpy()
        begins = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(bucket))
        packed = []
        for a, b in zip(begins[:-1], begins[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _SEGMENTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows.slice(a, b - a))
            packed.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(bucket[begins[:-1]]), np.full(len(packed), task + n, np.int64), pa.array(packed, pa.binary())], ["bucket", "segment", "packed"])


def packed_words(bodies: DataFrame, origin: int, analyzer: str = "simple") -> DataFrame:
    """The index of ``bodies``, by bucket and segment: what ``unpacked`` makes rows of. Neither a text nor a single posting is ever a row of a shuffle."""
    return bodies.select("blob_hash", words_of("body").alias("words")).mapInArrow(lambda batches: _packed(_of_words(batches, analyzer), origin), PACKED)


def packed_postings(postings: DataFrame, origin: int) -> DataFrame:
    """``packed_words`` of an index that is there as rows of term, blob_hash and positions."""
    return postings.select("term", "blob_hash", "positions").mapInArrow(lambda batches: _packed(_of_rows(batches), origin), PACKED)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("packed"):
            with pa.ipc.open_stream(packed.as_buffer()) as read:
                yield from read


def unpacked(packed: DataFrame) -> DataFrame:
    """The rows (``SEGMENTS``) of packed segments."""
    return packed.mapInArrow(_unpack, SEGMENTS)


def unfolded(stored: DataFrame) -> DataFrame:
    """bucket, term, blob_hash, positions and home of the rows of a stored index; filters on the first two and the home reach its scan."""
    each = stored.where("bucket >= 0").select("bucket", "term", "origin", "segment", "ends", "places", F.posexplode("numbers").alias("nth", "number"))
    begin = F.when(F.col("nth") == 0, 0).otherwise(F.col("ends")[F.col("nth") - 1])
    positions = F.slice("places", begin + 1, F.col("ends")[F.col("nth")] - begin).alias("positions")
    named = stored.where("bucket < 0").select("origin", "segment", F.col("numbers")[0].alias("number"), F.col("term").alias("blob_hash"), (-1 - F.col("bucket")).alias("home"))
    return each.select("bucket", "term", "origin", "segment", "number", positions).join(named, ["origin", "segment", "number"]).select("bucket", "term", "blob_hash", "positions", "home")


def home_of(blob_hash: Column) -> Column:
    """The bucket of a body, of the entries that refer to it and of its places in the index's directory."""
    return (F.crc32(blob_hash.cast("binary")) % HOMES).cast("int")


def term_directory(postings: DataFrame) -> DataFrame:
    """bucket, term, df (bodies that hold the term) and homes (the buckets of those bodies, ``HOMES`` at most): what a search reads first."""
    bits = F.call_function("shiftleft", F.lit(1).cast("long"), home_of(F.col("blob_hash")))
    return _directory(postings.select("bucket", "term", F.lit(1).alias("n"), bits.alias("bits")), "bucket", "term")


def segment_directory(stored: DataFrame, spread: int) -> DataFrame:
    """``term_directory`` of the rows of a stored index, dealt by bucket: one shuffle of a row for each term and segment."""
    rows = stored.where("bucket >= 0").select("bucket", F.pmod(F.xxhash64("term"), F.lit(spread)).alias("part"), "term", F.size("numbers").alias("n"), F.col("homes").alias("bits"))
    return _directory(rows.repartition("bucket", "part"), "bucket", "part", "term")


def _directory(rows: DataFrame, *key: str) -> DataFrame:
    held = rows.groupBy(*key).agg(F.sum("n").alias("df"), F.bit_or("bits").alias("bits"))  # a number for each term, not a set that grows
    homes = F.filter(F.sequence(F.lit(0), F.lit(HOMES - 1)), lambda h: F.call_function("getbit", F.col("bits"), h) == 1)
    return held.select("bucket", "term", "df", homes.alias("homes"))
