"""Bundles (what a client publishes) and snapshots (what readers of the corpus see), as Parquet datasets.

A snapshot is a list of versions, oldest first. Each import writes a version of level 0 with what it adds and names the sessions that it replaces; readers
put the versions together. As soon as ``FANOUT`` versions of one level stand at the end of the list, they are merged into one of the next level, so n
imports leave (FANOUT - 1) log n versions at most, and a row is written again log n times. Numbered commit files name the versions; the highest complete
one counts, earlier ones can be read as long as ``vacuum`` keeps them. There is one writer at a time.

Entries and bodies are dealt into ``HOMES`` folders by the body's hash, and sorted by it; a directory of the index tells for each term in which homes its bodies are.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators.ingest import (
    ANALYZER, HOMES, IMPORTS, POSTING_BUCKETS, SEGMENTS, Corpus, Delta, home_of, packed_postings, packed_words, segment_directory, summed_blobs, unfolded, unpacked,
)

FANOUT = 4
ENTRIES = "session_id long, seq int, role string, ts string, header_line string, blob_hash string, home int"
BODIES = "blob_hash string, body string, home int"
TABLES = ("sessions", "removed", "blobs", "skipped", "entries", "bodies", "postings", "terms", "imports")
TERMS = "bucket int, term string, df long, homes array<int>"


def write_bundle(sessions: DataFrame, entries: DataFrame, bodies: DataFrame, path: str) -> None:
    """Manifest rows, entry maps and every body once."""
    with shuffles_freed(sessions.sparkSession):
        sessions.write.option("compression", "zstd").parquet(f"{path}/sessions")
        entries.write.option("compression", "zstd").parquet(f"{path}/entries")
        bodies.dropDuplicates(["blob_hash"]).write.option("compression", "zstd").parquet(f"{path}/bodies")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, entries, bodies)."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("sessions", "entries", "bodies"))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def _scan(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """The columns of ``schema`` of one path, or of several that are folders (``v=...``) of one table."""
    read = spark.read.schema(schema)
    read = read.option("basePath", paths[0].rsplit("/", 1)[0]) if len(paths) > 1 else read
    return read.parquet(*paths).select(*[c.split()[0] for c in schema.split(", ")])


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written or collected inside are deleted when that is done, not when the driver happens to collect its garbage.

    No data frame that is made inside should be run twice; ``write`` makes a plan of its own each time.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def _spread(spark: SparkSession, parts: int) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)


def _write_segments(rows: DataFrame, path: str) -> None:
    """Rows of an index (``SEGMENTS``), dealt by bucket, as a table partitioned by bucket and sorted by term. Numbers are stored as differences."""
    dealt = rows.sortWithinPartitions("bucket", "term", "segment").write.partitionBy("bucket").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for column in ("numbers", "ends", "places"):
        dealt = dealt.option(f"parquet.enable.dictionary#{column}.list.element", "false")
    dealt.parquet(path)


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """By bucket; a frequent term is spread over files by its segments."""
    return rows.repartition("bucket", F.pmod(F.xxhash64(*by), F.lit(_spread(rows.sparkSession, POSTING_BUCKETS))))


def _origin() -> int:
    return uuid.uuid4().int >> 65


def write_index(bodies: DataFrame, path: str, analyzer: str = ANALYZER) -> None:
    """The index of stored bodies. A segment's postings go through the shuffle as one compressed table for each bucket, and refer to its bodies by number."""
    with shuffles_freed(bodies.sparkSession):
        _write_segments(unpacked(_dealt(packed_words(bodies, _origin(), analyzer), "segment")), path)


def write_postings(postings: DataFrame, path: str) -> None:
    """An index that is there as rows (``build_postings``); best with a body's rows together."""
    with shuffles_freed(postings.sparkSession):
        _write_segments(unpacked(_dealt(packed_postings(postings, _origin()), "segment")), path)


def merge_indexes(spark: SparkSession, paths: list[str], path: str) -> None:
    """Several stored indexes of one folder as one: their segments stay as they are."""
    with shuffles_freed(spark):
        _write_segments(_dealt(_segments(spark, *paths), "origin", "segment"), path)


def _segments(spark: SparkSession, *paths: str) -> DataFrame:
    return _scan(spark, SEGMENTS, *paths)


def read_postings(spark: SparkSession, *paths: str) -> DataFrame:
    """The index of one path or several of one folder, as rows of bucket, term, blob_hash, positions and home; filters on bucket, term and home reach the scan."""
    return unfolded(_segments(spark, *paths))


def write_terms(spark: SparkSession, index: str, path: str) -> None:
    """The directory of a stored index, dealt by bucket and sorted by bucket and term."""
    with shuffles_freed(spark):
        rows = segment_directory(_segments(spark, index), _spread(spark, POSTING_BUCKETS))
        rows.sortWithinPartitions("bucket", "term").write.option("compression", "zstd").parquet(path)


def read_terms(spark: SparkSession, *paths: str) -> DataFrame:
    return _scan(spark, TERMS, *paths)


def write_homes(rows: DataFrame, path: str, once: bool = False, rounds: int = 1) -> None:
    """Entries or bodies in a folder for each home, sorted by the body's hash; large homes in several files. ``once``: one row of each hash, in the same shuffle.

    In several rounds, each with homes of its own, only a part of ``rows`` is in shuffle files at a time, but what makes them is read again each time.
    """
    part = F.pmod(F.xxhash64("blob_hash"), F.lit(_spread(rows.sparkSession, HOMES)))
    homed = rows.drop("home").withColumns({"home": home_of(F.col("blob_hash")), "part": part})
    for n in range(rounds):
        mine = homed.where((F.col("home") % rounds).eqNullSafe(n) | (F.col("home").isNull() if n == 0 else F.lit(False))) if rounds > 1 else homed
        dealt = mine.repartition("home", "part")
        dealt = dealt.dropDuplicates(["home", "part", "blob_hash"]) if once else dealt
        with shuffles_freed(rows.sparkSession):
            dealt.drop("part").sortWithinPartitions("home", "blob_hash").write.mode("append").partitionBy("home").option("compression", "zstd").parquet(path)


def _rounds(spark: SparkSession) -> int:
    """In how many rounds an import's new bodies are written: all those of the bundle are in shuffle files before it is known which are new."""
    return min(4, 1 + int(spark.conf.get("spark.sql.shuffle.partitions")) // HOMES)


def read_homes(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Entries (``ENTRIES``) or bodies (``BODIES``) of one path or several of one folder, in one scan; a filter on the home reaches it."""
    return _scan(spark, schema, *paths)


def write_delta(delta: Delta, imports: DataFrame, root: str, merged: list[str] | None = None, level: int = 0) -> str:
    """Write what an import adds under a new version. Nothing that is there is written again but the small ledger of imports.

    The index is built from the bodies as they were written, or put together from those of the versions ``merged``. What a failure leaves unfinished is deleted.
    """
    version, spark = f"v={level}-{uuid.uuid4().hex}", imports.sparkSession

    def index() -> None:
        write_homes(delta.bodies, f"{root}/bodies/{version}", rounds=_rounds(spark))
        if merged is None:
            write_index(read_homes(spark, BODIES, f"{root}/bodies/{version}"), f"{root}/postings/{version}")
        else:
            merge_indexes(spark, [f"{root}/postings/{v}" for v in merged], f"{root}/postings/{version}")
        write_terms(spark, f"{root}/postings/{version}", f"{root}/terms/{version}")

    def plain(name: str) -> Callable[[], None]:
        return lambda: getattr(delta, name).write.option("compression", "zstd").parquet(f"{root}/{name}/{version}")

    jobs = [index, lambda: write_homes(delta.entries, f"{root}/entries/{version}"), *map(plain, ("blobs", "skipped", "sessions", "removed"))]
    jobs.append(lambda: imports.coalesce(1).write.parquet(f"{root}/imports/{version}"))
    try:
        with shuffles_freed(spark), ThreadPoolExecutor(len(jobs)) as pool:  # the tables don't depend on each other, and most of them are small
            for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
                done.result()
    except BaseException:
        delete_version(spark, root, version)
        raise
    return version


def delete_version(spark: SparkSession, root: str, version: str) -> None:
    for table in TABLES:
        delete(spark, f"{root}/{table}/{version}")


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, at = _file(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def commits(spark: SparkSession, root: str) -> dict[int, list[str]]:
    """The versions that each complete commit names, by number."""
    found = {}
    for name in _listed(spark, f"{root}/commits"):
        if name.endswith(".json") and name[:-5].isdigit():
            with contextlib.suppress(ValueError, TypeError):  # an unfinished file is not a commit
                found[int(name[:-5])] = json.loads("".join(r.value for r in spark.read.text(f"{root}/commits/{name}").collect()))["versions"]
    return found


def versions(spark: SparkSession, root: str) -> list[str]:
    """The versions that the highest complete commit names, oldest first; none before the first."""
    fs, at = _file(spark, f"{root}/commits")
    if not fs.exists(at):
        return []
    names = sorted((f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")), reverse=True)
    for name in names:
        with contextlib.suppress(ValueError, TypeError):  # an unfinished file is not a commit
            return json.loads("".join(r.value for r in spark.read.text(f"{root}/commits/{name}").collect()))["versions"]
    return []


def commit(spark: SparkSession, root: str, names: list[str]) -> None:
    """Make ``names`` the corpus: a numbered file appears under its final name in one step, and the highest complete one counts.

    There is one writer at a time. No earlier commit is touched, so readers always find one, and a failed import leaves the corpus as it was.
    """
    fs, at = _file(spark, f"{root}/commits")
    taken = [int(f.getPath().getName()[:-5]) for f in (fs.listStatus(at) if fs.exists(at) else []) if f.getPath().getName()[:-5].isdigit()]
    number = max(taken, default=0) + 1
    _, new = _file(spark, f"{root}/commits/.{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(json.dumps({"versions": names}).encode()))
    out.close()
    _, final = _file(spark, f"{root}/commits/{number:012d}.json")
    if not fs.rename(new, final):
        raise OSError(f"commit {number} of {root} exists already")


def read_versions(spark: SparkSession, root: str, names: list[str]) -> Corpus:
    """The corpus of the given versions: their rows, without the sessions that a later one replaced. Each table is one scan of all its versions."""
    paths = lambda table: [f"{root}/{table}/{v}" for v in names]
    rows = {t: spark.read.parquet(*paths(t)) for t in ("sessions", "removed", "blobs", "skipped")}
    live = lambda df: df.join(rows["removed"].distinct(), "session_id", "left_anti")
    return Corpus(
        live(rows["sessions"]), live(read_homes(spark, ENTRIES, *paths("entries"))), summed_blobs(rows["blobs"]), read_homes(spark, BODIES, *paths("bodies")), rows["skipped"],
        read_postings(spark, *paths("postings")), spark.read.parquet(f"{root}/imports/{names[-1]}"), read_terms(spark, *paths("terms")),
    )


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> Corpus | None:
    """The corpus as of the last commit, or of an earlier one; None before the first."""
    names = versions(spark, root) if number is None else commits(spark, root)[number]
    return read_versions(spark, root, names) if names else None


def write_snapshot(corpus: Corpus, root: str) -> str:
    """Write a whole corpus as one new version and commit it alone: a first version, or all made one."""
    spark = corpus.sessions.sparkSession
    nothing = corpus.sessions.select("session_id").limit(0)
    delta = Delta(corpus.sessions, nothing, corpus.entries, corpus.blobs, corpus.bodies, corpus.skipped, corpus.postings)
    imports = corpus.imports if corpus.imports is not None else spark.createDataFrame([], IMPORTS)
    version = write_delta(delta, imports, root)
    commit(spark, root, [version])
    return version


def level_of(version: str) -> int:
    return int(version.removeprefix("v=").split("-")[0])


def settle(spark: SparkSession, root: str) -> list[str]:
    """Merge the last versions by level until fewer than ``FANOUT`` of one level stand at the end; each merge is a commit of its own."""
    names = versions(spark, root)
    while len(names) >= FANOUT and len({level_of(v) for v in names[-FANOUT:]}) == 1:
        older, group = names[:-FANOUT], names[-FANOUT:]
        merged = read_versions(spark, root, group)
        removed = spark.read.parquet(*[f"{root}/removed/{v}" for v in group]).distinct()
        removed = removed if older else removed.limit(0)  # what it names was in the group itself, or is in older versions
        delta = Delta(merged.sessions, removed, merged.entries, merged.blobs, merged.bodies, merged.skipped, merged.postings)
        names = [*older, write_delta(delta, merged.imports, root, group, level_of(group[-1]) + 1)]
        commit(spark, root, names)
    return names


def vacuum(spark: SparkSession, root: str, keep: int | None = None) -> list[str]:
    """Delete what no commit names: versions and work of imports that failed; with ``keep``, first all but the last commits. Returns the versions deleted.

    The writer calls it between imports. Readers of a commit that is dropped have to be done.
    """
    found = commits(spark, root)
    for number in sorted(found)[: max(0, len(found) - keep)] if keep else []:
        delete(spark, f"{root}/commits/{number:012d}.json")
        del found[number]
    named = {v for names in found.values() for v in names}
    gone = sorted({v for table in TABLES for v in _listed(spark, f"{root}/{table}")} - named)
    for v in gone:
        delete_version(spark, root, v)
    delete(spark, f"{root}/work")
    return gone
