"""SimHash near-duplicate detection by a segment-popcount embedding and a grid range-join.

Fingerprints. A text's shingles of ``words`` words are hashed by XXH64; a bit of the fingerprint is 1 if it is 1 in more than half of the
hashes.

Candidates. A fingerprint is cut into 32 segments of two bits; its embedding is the vector of the segments' bit counts. The Manhattan
distance of two embeddings is at most the Hamming distance of the fingerprints. The counts are held as a thermometer
(0, 01, 11), so that the Manhattan distance is the number of differing bits of two such words. The 32 axes are dealt to
``AXES`` groups: two points within distance 2 agree in all but two groups, so each point enters the grid once for each
choice of two groups left out, in the cell of its other coordinates. Points that share a cell are compared by Manhattan distance, then
exactly. A cell with more than ``crowd`` points isn't compared pair by pair: its points are linked through midpoints. Two words differ in at
most two bits exactly if one word lies within one bit of both; so each point names itself and its 64 neighbours, and the
points that name the same word are linked to the smallest of them. That is exact, and linear in the points.

Groups. Links between different fingerprints are contracted by alternating large and small stars, each round written to the
shared folder, until every fingerprint points at the smallest of its component.

Scale. Equal fingerprints are one point from the start, so a group of copies costs one row per task; nothing is collected, no
group of unbounded size is, and the join back to the documents is one that Spark can split at a hot fingerprint.

Defined results. Null and empty texts have no words, fingerprint zero, and are linked like any other. A null doc_id is never the
smallest; a component of null ids only has a null id. Texts of any length are read whole. Repeated rows stay, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import ASCII_LOWER, by_batch, raw, remove, scratch_path, stored

DISTANCE = 2
AXES = 6
_LOW = 0x5555555555555555


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    parts = text.translate(ASCII_LOWER).split() if text else []
    n = len(parts)
    if not n:
        return 0
    form = b" ".join(parts)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(form, seed)]
    else:
        ends = np.append(np.flatnonzero(np.frombuffer(form, np.uint8) == 32), len(form))
        starts = np.append(0, ends[:-1] + 1)[: n - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(form[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, h (hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            found = np.array([fingerprint(t, words) for t in raw(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found.view(np.int64))], ["doc_id", "h", "fp"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, each as a thermometer of two bits: 0, 1 or 2 ones from the right."""
    left, right = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(F.lit(_LOW))
    return left.bitwiseOR(right).bitwiseOR(F.shiftleft(left.bitwiseAND(right), 1))


def _grids() -> list[int]:
    """Masks (signed) of the coordinates that stay, for each choice of ``DISTANCE`` groups of axes to leave out."""
    edges = [round(32 * g / AXES) for g in range(AXES + 1)]
    groups = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(groups[g] for g in kept) for kept in combinations(range(AXES), AXES - DISTANCE)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(points: DataFrame, crowd: int = 64) -> DataFrame:
    """a > b: links between different fingerprints (column fp of ``points``), enough to connect all within distance 2."""
    u = embedding(F.col("fp"))
    cells = points.select(
        "fp", F.posexplode(F.array(*[u.bitwiseAND(F.lit(m)) for m in _grids()])).alias("grid", "cell")
    )
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(cells.join(sizes.hint("merge"), ["grid", "cell"]), "simhash-cells")
    few = shared.where(F.col("n") <= crowd).groupBy("grid", "cell").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = few.select(
        F.explode(
            F.flatten(
                F.transform("fps", lambda x, i: F.transform(
                    F.filter("fps", lambda y, j: (j > i) & (differing(embedding(x), embedding(y)) <= DISTANCE)),
                    lambda y: F.struct(y.alias("a"), x.alias("b")),
                ))
            )
        ).alias("p")
    ).select("p.a", "p.b").where(differing(F.col("a"), F.col("b")) <= DISTANCE)
    many = shared.where(F.col("n") > crowd).select("fp").distinct()
    bits = [1 << i for i in range(63)] + [-(1 << 63)]
    words = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(b)) for b in bits])).alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    through = words.join(hubs.hint("merge"), "word").where("fp > hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    return near.unionByName(through).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of every node of ``edges`` (a > b) that isn't a root."""
    spark = edges.sparkSession
    path, mark = scratch_path(spark, "simhash-links"), None
    edges.write.parquet(path)
    while True:
        now = spark.read.parquet(path)
        signature = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if signature == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = signature
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Least neighbours are tables of their own: a join of two plain shuffles is one that Spark can split at a node with many links.
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "simhash-least")
        large = stored(both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "simhash-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "simhash-least")
        small = large.join(least.hint("merge"), "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")
        )
        after = scratch_path(spark, "simhash-links")
        small.select("p.a", "p.b").where("a > b").distinct().write.parquet(after)
        remove(spark, path)
        path = after


def group_documents(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp, component_id and h (text hash) of every row; component_id is the smallest doc_id that links reach, its own included."""
    prints = stored(fingerprints(docs, words), "simhash-prints")
    points = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    roots = components(links(points.select("fp")))
    rooted = points.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named.hint("merge"), "root").select("fp", "component_id")
    return prints.join(by_print.hint("merge"), "fp").select("doc_id", "fp", "component_id", "h")


def without(docs: DataFrame, losers: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash are in ``losers`` (doc_id, h); only those few are looked up."""
    losers = stored(losers.select(F.col("doc_id").alias("loser_id"), F.col("h").alias("loser_h")).distinct(), "losers")
    mine = docs["doc_id"].eqNullSafe(losers["loser_id"]) & (F.xxhash64(docs["text"]) == losers["loser_h"])
    return docs.join(losers, mine, "left_anti")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows without an id stay, and so do repeated rows of that id."""
    return without(docs, group_documents(docs, words).where("doc_id <> component_id"))


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """The contract by comparing all pairs; for tests."""
    prints = {i: fingerprint((t or "").encode()) for i, t in docs}
    root = {i: i for i in prints}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a, b in combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= DISTANCE:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, f"{prints[i]:016x}", find(i)) for i in ids]
