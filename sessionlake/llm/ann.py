"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A unit vector is approximated by the sum of ``STAGES`` codewords, one of each full-dimensional codebook; a codebook is
fitted by k-means to what the earlier ones leave. Encoding keeps the ``BEAM`` best partial sums at each stage. The index holds each row's
code, the norm of its code's sum, the length of what the code leaves of the vector and a hash of the vector. A search builds a table of the query's inner
products with all codewords and scores a block's rows by table lookups and the stored norm; the best ``pool`` rows get the exact cosine in double precision. With what
its code leaves a row's cosine is bounded, so every other row of the block whose bound reaches the pool's k-th cosine gets the exact one too: no nearest row is missed,
however alike the codes are, and few rows are looked at where codes tell rows apart.

Scale. The codebooks are fitted to a bounded sample (``most_fit`` vectors by a hash of id and vector); every row is indexed. Rows and queries are dealt into
blocks of bounded size by a hash, and each pair of blocks is one task, which hands on ``k`` rows of each query: queries are a stated set
against all rows, and no task holds more than two blocks. Of equal vectors only the ``k + 1`` smallest ids are scored, which is all that any result can hold.

Defined results. Vectors that are null, zero, hold null or non-finite components, have no id, or are not of the commonest length take
no part. Repeated rows count once; of several vectors under one id that is a query, the smallest (as an array) asks. Ties go to the smaller
id. Fewer candidates than ``k`` give fewer rows; an empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import stored

STAGES, CODEWORDS, BEAM = 24, 256, 6
#: More than the single precision of table lookups can lose.
ROUNDING = 1e-4


def usable(v: Column) -> Column:
    d = lambda x: x.cast("double")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(d(x)) | (F.abs(d(x)) == float("inf")))
    return v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


def matrix(column) -> np.ndarray:
    """A list column as rows of doubles, each scaled by a power of two (which is exact) so that squares can't overflow."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1))[1][:, None])


def norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


class AdditiveQuantiser:
    def __init__(self, unit: np.ndarray, seed: int = 3, rounds: int = 6):
        rng = np.random.default_rng(seed)
        rest, books = unit.astype(np.float32), []
        for _ in range(STAGES):
            book = rest[rng.choice(len(rest), min(CODEWORDS, len(rest)), replace=False)].copy()
            for _ in range(rounds):
                near = self._nearest(rest, book)
                count = np.bincount(near, minlength=len(book))
                sums = np.zeros_like(book)
                np.add.at(sums, near, rest)
                some = count > 0
                book[some] = sums[some] / count[some, None]
                if not some.all():  # an empty cell starts again at the rows that are worst served
                    worst = np.argsort(-((rest - book[near]) ** 2).sum(1), kind="stable")[: (~some).sum()]
                    book[np.flatnonzero(~some)[: len(worst)]] = rest[worst]
            rest = rest - book[self._nearest(rest, book)]
            books.append(book)
        self.books = np.stack(books)  # stages, codewords, dimensions
        self.square = (self.books**2).sum(2)

    @staticmethod
    def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return np.argmax(x @ book.T - 0.5 * (book**2).sum(1), axis=1)

    def encode(self, unit: np.ndarray, block: int = 256) -> np.ndarray:
        """Codes (n, STAGES) by beam search over the stages."""
        return np.concatenate([self._beam(unit[i : i + block]) for i in range(0, len(unit), block)] or [np.zeros((0, STAGES), np.uint8)])

    def _beam(self, unit: np.ndarray) -> np.ndarray:
        n, k = len(unit), self.books.shape[1]
        rows = np.arange(n)[:, None]
        rest, codes = unit.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8)
        error = (rest**2).sum(2)
        for s in range(STAGES):
            # |rest - c|^2 = |rest|^2 - 2 rest.c + |c|^2
            grown = (error[:, :, None] - 2 * (rest @ self.books[s].T) + self.square[s]).reshape(n, -1)
            best = np.argpartition(grown, min(BEAM, grown.shape[1]) - 1, axis=1)[:, :BEAM]
            error, parent, word = grown[rows, best], best // k, best % k
            rest = rest[rows, parent] - self.books[s][word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), error.argmin(1)]

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[s, codes[:, s]] for s in range(STAGES))

    def inner(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries and codes' sums (queries, rows) by table lookups."""
        table = np.einsum("qd,skd->sqk", queries.astype(np.float32), self.books, optimize=True)
        out = np.zeros((len(queries), len(codes)), np.float32)
        for s in range(STAGES):
            out += np.take(table[s], codes[:, s], axis=1)
        return out


def fit(vectors: DataFrame, most_fit: int = 6000) -> AdditiveQuantiser | None:
    """Codebooks from ``most_fit`` vectors at most of a table of different usable rows (vec_id, embedding)."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "embedding", F.lit("sample")), "vec_id", "embedding").limit(most_fit).toArrow()
    if not rows.num_rows:
        return None
    m = matrix(rows.column("embedding"))
    return AdditiveQuantiser(m / norms(m)[:, None])


def index(vectors: DataFrame, quantiser: AdditiveQuantiser | None) -> DataFrame:
    """vec_id, embedding, code, sum_norm, error (the length of what the code leaves of the unit vector) and vh (a hash of the vector) of every row."""
    shared = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column(1))
                codes = shared.value.encode(m / norms(m)[:, None])
                sums = shared.value.sums(codes)
                size, error = norms(sums).astype(np.float32), (norms(m / norms(m)[:, None] - sums) + ROUNDING).astype(np.float32)
                same = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in m], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(size), pa.array(error), pa.array(same)],
                    ["vec_id", "embedding", "code", "sum_norm", "error", "vh"],
                )

    kind = dict(vectors.dtypes)["embedding"]
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, code binary, sum_norm float, error float, vh long")


def _block_search(q: AdditiveQuantiser, k: int, pool: int):
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(cosine: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of the best row of each id, best first, ties by the smaller id."""
        order = np.lexsort((ids, -cosine))
        return order[np.sort(np.unique(ids[order], return_index=True)[1])]

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return kinds.empty_table()
        ids, same = rows.column("vec_id").to_numpy(), rows.column("vh").to_numpy()
        order = np.lexsort((ids, same))
        first = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        keep = order[place <= k]  # of equal vectors the smallest ids
        keep = keep[np.argsort(ids[keep], kind="stable")]
        ids = ids[keep]
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, STAGES)[keep]
        size, error = rows.column("sum_norm").to_numpy()[keep], rows.column("error").to_numpy()[keep]
        m = matrix(rows.column("embedding"))[keep]
        lengths = norms(m)
        asked, qm = queries.column("vec_id").to_numpy(), matrix(queries.column("embedding"))
        asked_lengths = norms(qm)
        found = []
        for at in range(0, len(asked), 64):
            inner = q.inner(qm[at : at + 64] / asked_lengths[at : at + 64, None], codes)
            for j, near in enumerate(inner, at):
                near[ids == asked[j]] = -np.inf
                cosine = lambda rows_: (qm[j] * m[rows_]).sum(axis=1) / (lengths[rows_] * asked_lengths[j])  # noqa: B023, E731
                rough = near / np.maximum(size, 1e-9)
                first_rows = np.argpartition(-rough, pool - 1)[:pool] if len(rough) > pool else np.arange(len(rough))
                first_rows = first_rows[near[first_rows] > -np.inf]
                first_cosines = cosine(first_rows)
                top = best(first_cosines, ids[first_rows])
                # what can reach the pool's k-th: a row's cosine is at most its code's inner product and the length of what the code leaves
                least = first_cosines[top[k - 1]] if len(top) >= k else -np.inf
                reach = np.flatnonzero((near + error >= least) & (near > -np.inf))
                exact = cosine(reach)
                top = best(exact, ids[reach])[:k]
                found.append((np.full(len(top), asked[j]), ids[reach[top]], exact[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=kinds)

    return search


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, pool: int = 200, row_block: int = 65_536, query_block: int = 4096, most_fit: int = 6000
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows of each row that ``is_query`` (on vec_id) holds for."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    dimensions = lengths["size"] if lengths else 0
    rows = rows.where(F.size("embedding") == dimensions).distinct()
    quantiser = fit(rows, most_fit)
    indexed = stored(index(rows, quantiser), "ann-index")
    n, wide = indexed.count(), max(1.0, dimensions / 64)  # blocks of longer vectors have fewer rows
    # blocks of rows are smaller than row_block only to give every core some
    blocks = max(1, math.ceil(n * wide / row_block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 1024)))
    queries = indexed.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    query_blocks = max(1, math.ceil(queries.count() * wide / query_block))
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    block_of = lambda count, *by: F.pmod(F.xxhash64("vec_id", *by), F.lit(count).cast("long"))
    left = queries.withColumn("qb", block_of(query_blocks)).withColumn("rb", every(blocks))
    right = indexed.withColumn("rb", block_of(blocks, "vh")).withColumn("qb", every(query_blocks))
    found = (
        left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb"))
        .applyInArrow(_block_search(quantiser, k, pool), "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id can have several vectors
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(vectors: list[tuple[int, list[float] | None]], every: int = 50, k: int = 5) -> dict[int, list[tuple[float, int]]]:
    """The exact answers, for measuring recall in tests."""
    good = [(i, v) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    m = np.array([v for _, v in good], dtype=np.float64)
    m /= norms(m)[:, None]
    ids = np.array([i for i, _ in good])
    out = {}
    for j, (i, _) in enumerate(good):
        if i % every == 0:
            s = (m * m[j]).sum(1)
            keep = np.flatnonzero(ids != i)
            top = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
            out[i] = [(float(s[t]), int(ids[t])) for t in top]
    return out
