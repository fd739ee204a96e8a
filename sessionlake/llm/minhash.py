"""MinHash near-duplicate detection on bottom-k sketches from one hash function.

Sets. A text's different runs of ``WORDS`` words (the whole text if it has fewer), as 64-bit hashes. Texts of equal sets are one point from the
start. A point's sketch is the ``K`` least hashes of its set; a set of fewer is its own sketch. Two points are linked if their
sets share at least ``SHARE`` of their union.

Estimate. Of the ``K`` least hashes of two sets' union, which the two sketches hold, those that both sketches have are a sample without
replacement: of linked points at least 85 % in the mean. A pair is let pass from ``LEAST`` of ``K`` on: one link at exactly 0.85 is
missed with probability 2e-9 (a more similar one less); if the union has at most ``K`` hashes, the count is exact and decides.

Candidates. Each retained hash has an inverted list of points. Linked points have ``LEAST`` retained hashes in common, so with
each sketch in order of frequency one of the first ``K - LEAST + 1`` is common too, and only the lists of those are made: a passage that
many texts share stays out of them unless it is most of a text. Within a list each point is paired with the list's hub, the point whose lists are longest in
sum; the pairs' overlaps are counted over all lists, the estimate filters them, the exact sets verify them, and links are contracted.

Of a large group of edited copies many aren't linked to its hub but to some others. So each point of a list that still holds several
groups meets a member of that list's largest group: of a drawn eighth, another one in each list, the member whose lists are longest in sum. Again estimated, verified and contracted.

Lists that hold several groups after that don't tell which of their other pairs are links. Their points are joined by prefix filtering over full
sets (``near_copies.by_prefix``), which pairs only texts of different groups that share one of their rarest shingles, and is exact.

Scale. Sets are computed again from the texts, for points with a list in common with others only, and are shuffled once per pair. No group is
collected, no list is paired with itself; hubs and met members give two pairs per point and list. Joins at hot lists or copies are such as Spark can split.

Defined results. Texts without words have an empty set and are linked with nothing. A null doc_id is never the smallest; a component of null
ids only has a null id, and its rows are kept. Repeated rows stay, an empty table gives no rows, texts of any length are read whole, other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import ASCII_LOWER, by_batch, raw, stored
from sessionlake.llm.near_copies import WORDS, by_prefix, shingles, verified
from sessionlake.llm.simhash import components

SHARE = (17, 20)
K, LEAST = 64, 35
_TOP = np.uint64(1 << 63)


def _signed(hashes: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers in the same order."""
    return (hashes ^ _TOP).view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (digest of the set), n (its size) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches, 4 << 20):
            found = [shingles(t) for t in raw(batch, "text")]
            fps = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())
            sizes = pa.array([len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), fps, sizes, _lists([_signed(s[:K]) for s in found])], ["doc_id", "h", "fp", "n", "sketch"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, fp binary, n long, sketch array<long>")


def full_sets(docs: DataFrame, points: DataFrame) -> DataFrame:
    """row and shingles of the given points (row, doc_id, h), from their texts."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    wanted = points.select("row", F.col("doc_id").alias("of"), F.col("h").alias("of_h"))
    found = keyed.join(wanted.hint("merge"), (F.col("h") == F.col("of_h")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("row", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([_signed(shingles(t)) for t in raw(batch, "text")])], ["row", "shingles"])

    return found.mapInArrow(run, "row long, shingles array<long>").dropDuplicates(["row"])  # repeated rows have one text


def needed(n: Column) -> Column:
    """How many retained hashes a point of n shingles has in common with each point that it is linked to and that passes the estimate."""
    part, whole = SHARE
    return F.least(F.lit(LEAST), F.ceil(n * part / whole - 1e-9))


def passes(a: str, b: str) -> Column:
    """The union sketch's estimate of two sketches is high enough."""
    part, whole = SHARE
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    both = F.size(F.array_intersect(least, F.array_intersect(a, b)))
    return F.when(F.size(least) < K, both * whole >= F.size(least) * part).otherwise(both >= LEAST)


def inverted_lists(points: DataFrame) -> DataFrame:
    """row, v and df: the retained hashes by whose lists all candidates of a point (row, n, sketch) can be found, rare ones first, and the lists' sizes."""
    each = points.select("row", "n", F.explode("sketch").alias("v"))
    alive = stored(each.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "minhash-lists")
    ordered = each.join(alive.hint("merge"), "v").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("t"))
    size = F.least(F.col("n"), F.lit(K))
    first = size - needed(F.col("n")) + 1 - (size - F.size("t"))  # hashes that no other point has come first
    return ordered.select("row", F.explode(F.slice("t", 1, F.greatest(F.lit(0), first).cast("int"))).alias("x")).select("row", "x.v", "x.df")


def overlaps(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a > b of a point and a hub with the number of lists that name them; v, row and score of all lists of two points or more).

    A point's score is the sum of its lists' lengths: in a group of edited copies the greater, the fewer edits it has.
    """
    lists = stored(lists, "minhash-prefixes")
    sizes = lists.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(lists.join(sizes.hint("merge"), "v").select("row", "v", "size"), "minhash-shared")
    scored = stored(shared.join(shared.groupBy("row").agg(F.sum("size").alias("score")).hint("merge"), "row"), "minhash-scored")
    hubs = scored.groupBy("v").agg((-F.max(F.struct("score", (-F.col("row")).alias("least")))["least"]).alias("hub"))
    named = shared.join(stored(hubs, "minhash-hubs").hint("merge"), "v").where("row <> hub")
    pairs = named.groupBy(F.greatest("row", "hub").alias("a"), F.least("row", "hub").alias("b")).agg(F.count("*").alias("overlap"))
    return pairs, scored.select("v", "row", "score")


def estimated(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a > b) that the union sketch lets pass."""
    sides = [points.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")).hint("merge") for x in "ab"]
    part, whole = SHARE
    sized = F.least("na", "nb") * whole >= F.greatest("na", "nb") * part
    return pairs.join(sides[1], "b").join(sides[0], "a").where(sized).where(passes("sa", "sb")).select("a", "b")


def _rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """v, row, score and root of the lists that hold several groups."""
    rooted = lists.select("v", "row", "score").join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left")
    rooted = stored(rooted.select("v", "row", "score", F.coalesce("root", "row").alias("root")), "minhash-rooted")
    mixed = rooted.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("v")
    return stored(rooted.join(mixed.hint("merge"), "v", "left_semi"), "minhash-mixed")


def _meetings(mixed: DataFrame) -> DataFrame:
    """a > b: each point with a member of the largest group of each of its lists: the one of greatest score among a drawn eighth of that list."""
    drawn = F.pmod(F.xxhash64("row", "v"), F.lit(8)) == 0
    groups = mixed.groupBy("v", "root").agg(F.count("*").alias("size"), F.max(F.struct(drawn.alias("drawn"), "score", (-F.col("row")).alias("least"))).alias("best"))
    groups = groups.select("v", "root", "size", (-F.col("best.least")).alias("host"))
    largest = stored(groups.groupBy("v").agg(F.max(F.struct("size", (-F.col("root")).alias("least"), "host")).alias("one")), "minhash-hosts")
    largest = largest.select("v", (-F.col("one.least")).alias("host_root"), "one.host")
    met = mixed.join(largest.hint("merge"), "v").where("root <> host_root")
    return met.select(F.greatest("row", "host").alias("a"), F.least("row", "host").alias("b")).distinct()


def links(points: DataFrame, docs: DataFrame) -> DataFrame:
    """a > b: links that connect all points within reach (points: row, doc_id, h, n, sketch)."""
    pairs, mixed = overlaps(inverted_lists(points))
    shared = mixed.select("row").distinct()
    sets = stored(full_sets(docs, points.join(shared.hint("merge"), "row", "left_semi")), "minhash-sets")
    tried = stored(estimated(stored(pairs, "minhash-pairs"), points), "minhash-tried")
    found = stored(verified(tried, sets, SHARE), "minhash-links")
    mixed = _rooted(mixed, stored(components(found), "minhash-roots"))
    met = stored(estimated(_meetings(mixed).join(tried.hint("merge"), ["a", "b"], "left_anti"), points), "minhash-met")
    found = stored(found.unionByName(verified(met, sets, SHARE)), "minhash-links")
    roots = stored(components(found), "minhash-roots")
    mixed, tried = _rooted(mixed, roots), tried.unionByName(met)
    left = stored(mixed.select("row", "root").distinct(), "minhash-left")
    rest = by_prefix(sets.join(left.hint("merge"), "row").select("row", "root", F.size("shingles").alias("n"), "shingles"), SHARE)
    rest = stored(rest.join(tried.hint("merge"), ["a", "b"], "left_anti"), "minhash-rest")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(rest, sets, SHARE))


def group_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; component_id is the smallest doc_id that links reach, its own included."""
    rows = stored(sketches(docs), "minhash-sketches")
    one = F.min(F.struct("doc_id", "h"))
    points = rows.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("smallest"), one.alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    points = stored(points.select("fp", "smallest", "one.doc_id", "one.h", "n", "sketch").withColumn("row", F.monotonically_increasing_id()), "minhash-points")
    roots = components(links(points, docs))
    rooted = points.select("fp", "smallest", "row").join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left")
    rooted = rooted.select("fp", "smallest", F.coalesce("root", "row").alias("root"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    by_print = rooted.join(named.hint("merge"), "root").select("fp", "component_id")
    full = rows.where("n > 0").join(by_print.hint("merge"), "fp").select("doc_id", "n", "component_id")
    every = full.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM d
), n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s
), k AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM k JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple]:
    """The contract by comparing all pairs of sets of word tuples (different ids only); for tests."""
    root, sets = {i: i for i, _ in docs}, {}
    for i, t in docs:
        p = (t or "").encode().translate(ASCII_LOWER).split()
        sets[i] = {tuple(p[k : k + WORDS]) for k in range(max(1, len(p) - WORDS + 1))} if p else set()

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [(i, len(sets[i]), find(i), find(i) == i) for i in sorted(sets)]
