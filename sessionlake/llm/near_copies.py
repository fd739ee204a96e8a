"""Near copies: SimHash near-dedup (``simhash``) on five-word shingles, with a stated Jaccard similarity and exact verification.

Shingles. A text's runs of ``WORDS`` words (the whole text if it has fewer), as a set of 64-bit hashes. Two texts are near copies if their
sets share at least ``SHARE`` of their union; groups are the components of that relation. Texts of equal sets are one point from the start.

Candidates. SimHash fingerprints of the sets, range-joined within two bits by the segment-popcount grid, name close copies. A pair at
similarity 0.8 differs in about 10 of 64 bits, and two bits of 64 would be met once in about 500 fingerprints; so the pairs that the
grid can't see are named by ``BANDS`` fingerprints of ``ROWS`` minwise hashes each (a pair at similarity s agrees in none of them with probability
(1 - s^ROWS)^BANDS: 2e-6 at 0.8, less above).

Verification. First the grid's links, and each text of a band's cell with the cell's hub (the one that shares most cells with most texts, so that in a
group of edited copies it is close to what they were made from), are verified and contracted. Texts of cells that still hold
several groups are then joined by prefix filtering: with shingles in order of frequency (those that only one group has come first, as they can't
match), two similar texts share one of their first few. A crowd of texts that share half their words but have edits of their own thus meets nowhere.

Sets are kept as 32-bit hashes: a pair of texts of n shingles then has n^2 / 2^32 shingles in common by accident, which is none.

Scale. No pair is made but of a text and its cell's hub, or of texts that share a rare shingle; sets are shuffled once, and for
candidates only. Defined results: null and empty texts have no shingles and are copies of each other; a null doc_id is never the smallest, and rows
without an id stay; repeated rows of the smallest id all stay; an empty table gives no rows; other columns are carried, whatever their names.
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
from sessionlake.llm.simhash import components, without
from sessionlake.llm.simhash import links as links_of_fingerprints

WORDS = 5
SHARE = (4, 5)
BANDS, ROWS = 25, 4
_ODD = np.random.default_rng(42).integers(0, 1 << 63, WORDS + BANDS * ROWS + ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _MINWISE, _BAND = _ODD[:WORDS], _ODD[WORDS:-ROWS], _ODD[-ROWS:]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's different shingles; none for a text without words."""
    parts = text.translate(ASCII_LOWER).split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(p, 42) for p in parts], np.uint64)
    n = len(words) - WORDS + 1
    return np.unique(_mix(sum(words[j : j + n] * _PLACE[j] for j in range(WORDS))))


def bands(found: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of shingles; none for an empty set."""
    if not len(found):
        return np.empty(0, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (_MINWISE[:, None] * found[None, at : at + 1024]).min(axis=1))
    return _mix(_mix((_mix(least).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64))


def sketch(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles: a bit is 1 if it is 1 in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 14):
        ones += np.unpackbits(found[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big")


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), fp (digest of the set), n (its size), sim (its fingerprint), bands and shingles of every row."""

    def lists(found: list[np.ndarray], kind: type) -> pa.Array:
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(kind) if found else np.empty(0, kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches, 4 << 20):
            found = [shingles(t) for t in raw(batch, "text")]
            fps = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())
            sims = pa.array(np.array([sketch(s) for s in found], np.uint64).view(np.int64))
            short = [np.unique(s.astype(np.uint32)) for s in found]
            sizes = pa.array([len(s) for s in short], pa.int32())
            columns = [batch.column(0), batch.column(2), fps, sizes, sims, lists([bands(s) for s in found], np.int64), lists(short, np.int32)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "fp", "n", "sim", "bands", "shingles"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, fp binary, n int, sim long, bands array<long>, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """The pairs (a > b) whose sets are similar enough."""
    a, b = (sets.select(F.col("row").alias(x), F.col("shingles").alias(f"s{x}")).hint("merge") for x in "ab")
    common, both = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    part, whole = share  # common / (both - common) >= part / whole
    return pairs.join(b, "b").join(a, "a").where(common * (whole + part) >= both * part).select("a", "b")


def _lengths_allow(n: str, m: str, share: tuple[int, int] = SHARE) -> Column:
    part, whole = share
    return F.least(n, m) * whole >= F.greatest(n, m) * part


def _alike(points: DataFrame) -> DataFrame:
    """a > b: what SimHash links, as pairs of points with the smallest point of the same or of a linked fingerprint."""
    least = stored(points.where("n > 0").groupBy(F.col("sim").alias("fp")).agg(F.min("row").alias("least")), "near-sims")
    near = links_of_fingerprints(least.select("fp"))
    ends = [least.select(F.col("fp").alias(x), F.col("least").alias(f"{x}_row")).hint("merge") for x in "ab"]
    linked = near.join(ends[0], "a").join(ends[1], "b").select(F.greatest("a_row", "b_row").alias("a"), F.least("a_row", "b_row").alias("b"))
    same = points.where("n > 0").join(least.hint("merge"), F.col("sim") == F.col("fp")).where("row > least").select(F.col("row").alias("a"), F.col("least").alias("b"))
    return linked.unionByName(same)


def _needed(n: Column, m: Column, share: tuple[int, int]) -> Column:
    """The overlap that sets of n and m shingles need, rounded up."""
    part, whole = share
    return F.ceil(part * (n + m) / (part + whole) - 1e-9)


def by_prefix(sets: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    """a > b: candidate pairs of different roots (sets: row, root, n, shingles), by a rare shingle that both have among their first."""
    part, whole = share
    each = sets.select("row", "root", "n", F.explode("shingles").alias("s"))
    alive = each.groupBy("s").agg(F.count("*").alias("df"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    alive = stored(alive.select("s", "df"), "near-alive")
    ordered = each.join(alive.hint("merge"), "s").groupBy("row", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("t"))
    dead = F.col("n") - F.size("t")  # shingles that can't match come first
    first = F.slice("t", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * part / whole - 1e-9) + 1 - dead).cast("int"))
    probes = ordered.select("row", "root", "n", dead.alias("dead"), F.posexplode(first).alias("k", "x")).select("row", "root", "n", (F.col("dead") + F.col("k")).alias("i"), "x.s")
    probes = stored(probes, "near-prefixes")
    larger = probes.select("s", F.col("row").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("i").alias("ia"))
    smaller = probes.where(F.col("i") <= F.col("n") - _needed(F.col("n"), F.col("n"), share)).select("s", F.col("row").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    pairs = larger.join(smaller.hint("merge"), "s").where("ra <> rb and na >= nb").where(_lengths_allow("na", "nb", share))
    pairs = pairs.where(F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= _needed(F.col("na"), F.col("nb"), share))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def links(points: DataFrame, rows: DataFrame) -> DataFrame:
    """a > b: links that connect all points within reach (points: row, n, sim, bands; rows: row, shingles)."""
    cells = points.select("row", "n", F.explode("bands").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    crowded = stored(cells.join(sizes.hint("merge"), "cell"), "near-crowded")
    scored = crowded.join(crowded.groupBy("row").agg(F.sum("size").alias("score")).hint("merge"), "row")
    hubs = scored.groupBy("cell").agg(F.max(F.struct("score", (-F.col("row")).alias("least"), "n")).alias("hub"))
    hubs = stored(hubs.select("cell", (-F.col("hub.least")).alias("hub"), F.col("hub.n").alias("m")), "near-hubs")
    shared = stored(crowded.select("cell", "row", "n").join(hubs.hint("merge"), "cell"), "near-cells")
    by_band = shared.where("row <> hub").where(_lengths_allow("n", "m")).select(F.greatest("row", "hub").alias("a"), F.least("row", "hub").alias("b"))
    tried = stored(by_band.unionByName(_alike(points)).distinct(), "near-tried")
    wanted = shared.select("row").unionByName(tried.select(F.explode(F.array("a", "b")).alias("row"))).distinct()
    sets = stored(rows.join(wanted.hint("merge"), "row"), "near-sets")
    roots = stored(components(stored(verified(tried, sets), "near-links")), "near-roots")
    rooted = shared.select("cell", "row").join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left")
    rooted = stored(rooted.select("cell", "row", F.coalesce("root", "row").alias("root")), "near-rooted")
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    left = stored(rooted.join(mixed.hint("merge"), "cell", "left_semi").select("row", "root").distinct(), "near-mixed")
    rest = by_prefix(sets.join(left.hint("merge"), "row").select("row", "root", F.size("shingles").alias("n"), "shingles"))
    rest = stored(rest.join(tried.hint("merge"), ["a", "b"], "left_anti"), "near-rest")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(rest, sets))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows without an id stay."""
    rows = stored(prints(docs).withColumn("row", F.monotonically_increasing_id()), "near-prints")
    named = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")), "near-names")
    points = stored(rows.select("row", "n", "sim", "bands").join(named.select("row").hint("merge"), "row"), "near-points")
    roots = components(links(points, rows.select("row", "shingles")))
    rooted = named.join(roots.withColumnRenamed("node", "row").hint("merge"), "row", "left").select("fp", "least", F.coalesce("root", "row").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(groups.hint("merge"), "root").select("fp", "component_id")
    losers = rows.select("doc_id", "h", "fp").join(by_print.hint("merge"), "fp").where("doc_id <> component_id")
    return without(docs, losers)


def brute_force(docs: list[tuple[int, str | None]]) -> set[int]:
    """The ids that stay, by comparing all pairs of sets of word tuples; for tests."""
    root, sets = {i: i for i, _ in docs}, {}
    for i, t in docs:
        p = (t or "").encode().translate(ASCII_LOWER).split()
        sets[i] = {tuple(p[k : k + WORDS]) for k in range(max(1, len(p) - WORDS + 1))}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) * SHARE[1] >= len(sets[a] | sets[b]) * SHARE[0]:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in root if find(i) == i}
