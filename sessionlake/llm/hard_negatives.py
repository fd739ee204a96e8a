"""Hard-negative mining by exact integer scores from Kronecker-packed products.

Packing. ``FIELDS`` candidates at a time: their components of one dimension, biased so that none is negative, become the fields of
one wide integer. An anchor's components are biased too. Each anchor component is multiplied once with the wide integer of its dimension; the
sum of the products holds in each field the inner product of the biased vectors, since fields are wide enough for it and nothing is carried over. Taking
the biases' shares off again gives the exact scores of all the candidates.

Mining. First the ``n_positives`` best other rows of an anchor's label are found, then, for each anchor and positive, the first ``n_negatives`` rows of another
label whose score is at most the positive's and at least ``floor`` of it. Higher scores come first, ties go to the smaller id.

Scale. Anchors are a stated set against all rows. Rows and anchors are dealt by a hash into blocks of bounded size; each pair of blocks is one
task that holds only these two, and gives a few rows for each anchor. Within a block candidates are in order of label, so that the search for positives
multiplies those packs only that hold an anchor's label. The few rows of all blocks meet in windows per anchor, which Spark cuts before the shuffle.

Defined results. Rows with a null id, label or vector, or with null or non-finite components take no part. Of several rows under one id the
smallest (by vector, then label) takes part. Vectors are scored with vectors of their own length only; empty ones score 0. Components are held as longs
(larger ones as the nearest long), scores likewise; where a field needs more than 8 bytes the sums are taken apart one by one. An empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import stored

FIELDS = 512
_LONG = np.iinfo(np.int64)


class Packs:
    """Candidates (rows of integer components) packed for products with anchors."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        n, d = candidates.shape
        self.n, self.lift, self.bias = n, max(0, -int(anchors.min(initial=0))), max(0, -int(candidates.min(initial=0)))
        top = (int(anchors.max(initial=0)) + self.lift) * (int(candidates.max(initial=0)) + self.bias) * max(d, 1)
        self.width = next((w for w in (4, 8) if top < 1 << (8 * w - 2)), (top.bit_length() + 8) // 8)
        self.plain = self.width <= 8
        numbers = candidates if self.plain else candidates.astype(object)
        self.sums = numbers.sum(axis=1) * self.lift if d else np.zeros(n, np.int64)
        self.packs = [[self._wide(numbers[at : at + FIELDS, c]) for c in range(d)] for at in range(0, n, FIELDS)]

    def _wide(self, column: np.ndarray) -> int:
        if self.plain:
            return int.from_bytes((column + self.bias).astype(f"<u{self.width}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x + self.bias).to_bytes(self.width, "little") for x in column), "little")

    def scores(self, anchor: list[int], pack: int) -> np.ndarray:
        """The inner products of an anchor with the candidates of a pack."""
        lifted = [x + self.lift for x in anchor]
        at, most = pack * FIELDS, min(self.n, (pack + 1) * FIELDS)
        data = sum(map(mul, lifted, self.packs[pack])).to_bytes(self.width * (most - at), "little")
        if self.plain:
            fields = np.frombuffer(data, f"<u{self.width}").astype(np.int64)
        else:
            fields = np.array([int.from_bytes(data[k : k + self.width], "little") for k in range(0, len(data), self.width)], object)
        return fields - self.bias * sum(lifted) - self.sums[at:most]


def first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best: highest score, then smallest id."""
    if not scores.dtype.hasobject and len(scores) > 8 * n:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.array(sorted(range(len(scores)), key=lambda k: (-scores[k], ids[k]))[:n], np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if n else np.empty(0, np.int64)
    return flat.astype(np.int64).reshape(n, -1) if len(flat) else np.empty((n, 0), np.int64)


class _Block:
    """One block of anchors against one block of candidates, these in order of label and id."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        self.ids, self.labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        asked = _matrix(anchors.column("numbers"))
        self.anchors, self.packs = asked.tolist(), Packs(_matrix(rows.column("numbers")), asked)

    def scores(self, i: int, low: int, high: int) -> np.ndarray:
        """The scores of anchor i with the candidates in [low, high)."""
        if low >= high:
            return np.empty(0, np.int64)
        packs = range(low // FIELDS, (high - 1) // FIELDS + 1)
        return np.concatenate([self.packs.scores(self.anchors[i], p) for p in packs])[low - packs[0] * FIELDS :][: high - low]


def _clip(scores: list) -> pa.Array:
    return pa.array([min(max(int(s), _LONG.min), _LONG.max) for s in scores], pa.int64())


POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(n: int):
    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            block = _Block(anchors, rows)
            for i, (anchor, label) in enumerate(zip(anchors.column("vec_id").to_pylist(), anchors.column("label").to_pylist(), strict=True)):
                low, high = np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, "right")
                s, ids = block.scores(i, low, high), block.ids[low:high]
                s, ids = s[ids != anchor], ids[ids != anchor]
                out += [(anchor, int(ids[k]), s[k]) for k in first(s, ids, n)]
        a, p, s = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"anchor_id": pa.array(a, pa.int64()), "positive_id": pa.array(p, pa.int64()), "positive_score": _clip(s)})

    return search


def _negatives(n: int, floor: tuple[int, int]):
    part, whole = floor

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            block = _Block(anchors, rows)
            known = (anchors.column(c).to_pylist() for c in ("vec_id", "label", "positives"))
            for i, (anchor, label, positives) in enumerate(zip(*known, strict=True)):
                low, high = np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, "right")
                s = np.concatenate([block.scores(i, 0, low), block.scores(i, high, len(block.ids))])
                ids = np.concatenate([block.ids[:low], block.ids[high:]])
                for positive in positives:
                    most = positive["positive_score"]
                    least = -((-part * most) // whole)  # part * most <= whole * score, in exact numbers
                    some = np.flatnonzero((s >= least) & (s <= most))
                    out += [(anchor, positive["positive_id"], most, int(ids[k]), s[k]) for k in some[first(s[some], ids[some], n)]]
        a, p, ps, c, s = zip(*out, strict=True) if out else ((), (), (), (), ())
        names = ("anchor_id", "positive_id", "positive_score", "negative_id")
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, (a, p, ps, c), strict=True)} | {"negative_score": _clip(s)})

    return search


def usable(v: Column) -> Column:
    d = lambda x: x.cast("double")
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(d(x)) | (F.abs(d(x)) == float("inf")))


def numbered(vectors: DataFrame, vector: str = "embedding", factor: int = 256) -> DataFrame:
    """vec_id, label and numbers (floor of factor times each component) of the rows that take part, one for each id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    numbers = F.transform("v", lambda x: F.floor(x.cast("double") * factor))
    one = rows.select("vec_id", F.struct(numbers.alias("numbers"), "label").alias("one")).groupBy("vec_id").agg(F.min("one").alias("one"))
    return one.select("vec_id", "one.label", "one.numbers", F.size("one.numbers").alias("size"))


def mine(
    rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, floor: tuple[int, int] = (4, 5), row_block: int = 131_072, anchor_block: int = 8192
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows (vec_id, label, numbers, size) that ``is_anchor`` holds for."""
    spark = rows.sparkSession
    rows = stored(rows, "negatives-rows")
    n = rows.count()
    # blocks of rows are smaller than row_block only to give every core some
    blocks = max(1, math.ceil(n / row_block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 1024)))
    anchors = rows.where(is_anchor)
    anchor_blocks = max(1, math.ceil(anchors.count() / anchor_block))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    block_of = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count).cast("long"))
    key = ["size", "rb", "ab"]
    right = rows.withColumn("rb", block_of(blocks, "row")).withColumn("ab", every(anchor_blocks))

    def searched(asked: DataFrame, how, schema: str) -> DataFrame:
        left = asked.withColumn("ab", block_of(anchor_blocks, "anchor")).withColumn("rb", every(blocks))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(how, schema)

    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = searched(anchors, _positives(n_positives), POSITIVES).withColumn("n", F.row_number().over(best)).where(F.col("n") <= n_positives)
    few = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # n_positives at most
    asked = anchors.join(few.hint("merge"), F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    nearest = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = searched(stored(asked, "negatives-asked"), _negatives(n_negatives, floor), NEGATIVES)
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def corrupted(vectors: DataFrame) -> DataFrame:
    """Some labels moved to the next one of ten, as the contract of op13 has it."""
    label = F.col("label")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLE = """
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 5
"""


def brute_force(rows: Iterator[tuple[int, list[float] | None, int | None]]) -> list[tuple]:
    """The contract row by row, for different ids; for tests."""
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = ([math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a in (i for i in good if i % 100 == 0):
        scored = sorted((-sum(map(mul, good[a][0], good[c][0])), c) for c in good if c != a and len(good[a][0]) == len(good[c][0]))
        for ps, p in [(-s, c) for s, c in scored if good[c][1] == good[a][1]][:5]:
            fit = [(-s, c) for s, c in scored if good[c][1] != good[a][1] and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, p, k + 1, c, ps, s) for k, (s, c) in enumerate(fit)]
    return out
