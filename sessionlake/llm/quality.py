"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

A document becomes ``len(STATISTICS)`` numbers, computed over its whole text. These are standardised and mapped to
``FEATURES`` cosines of random projections, whose inner products approximate a Gaussian kernel. Each partition sums its
part of the normal equations; the sum is solved for ridge weights. Raw scores are then calibrated to probabilities by
pooling adjacent violators over score bins.

Scale. Scoring maps the documents once. Learning draws ``most_rows`` labelled rows at most, by a hash of id, text and label; only ids and text hashes move for
that, and statistics are computed of the drawn texts only. Then only statistics, partition sums and bin counts move.

Defined results. Null counts as empty; empty texts get the score of their statistics (all zero). Texts of any length are read whole. Rows with
a null label or id teach nothing; a row with several labels teaches each, repeated rows teach once. Without labelled rows every score is 0.5 (predicted 1). A score of
exactly 0.5 is predicted 1. Repeated rows and null ids stay, an empty table gives no rows, columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import by_batch, id_remainder, raw, stored

FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 5e-5, 5
BINS = 200
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "short_words", "distinct_words", "top_word", "adjacent_repeats",
    "distinct_sentences", "log_lines", "distinct_lines", "words_per_line", "letters", "upper", "upper_start", "digits", "spaces",
    "sentence_marks", "commas", "symbols", "beyond_ascii", "words_with_symbols", "entropy", "distinct_pairs", "compressed",
    "uneven_lines",
)

_KIND = np.zeros(256, np.int64)  # 0 symbol, then letters, capitals, digits, white space, marks of sentences, comma, beyond ASCII
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".?!:;'\"-()", b",", bytes(range(128, 256))), 1):
    _KIND[list(_chars)] = _i
_SYMBOL_TO_MARK = bytes(0x23 if _KIND[c] == 0 else c for c in range(256))


def statistics(text: bytes | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    counts_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds, share = np.bincount(_KIND, counts_of, 8) / n, counts_of[counts_of > 0] / n
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    sentences = [s for s in text.split(b".") if s.strip()]
    lines = text.split(b"\n")
    upper_start = sum(1 for x in words if 65 <= x[0] <= 90)
    marked = text.translate(_SYMBOL_TO_MARK).split()
    squeezer = zlib.compressobj(1)
    squeezed = sum(len(squeezer.compress(text[at : at + (1 << 20)])) for at in range(0, n, 1 << 20)) + len(squeezer.flush())
    lengths = np.fromiter(map(len, lines), np.float64, len(lines))
    return [
        np.log1p(n), np.log1p(len(words)), n / w, sum(1 for x in words if len(x) <= 3) / w, len(counts) / w,
        max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, len(set(sentences)) / max(1, len(sentences)),
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), kinds[1], kinds[2], upper_start / w, kinds[3], kinds[4],
        kinds[5], kinds[6], kinds[0], kinds[7], sum(1 for x in marked if b"#" in x) / w, -(share * np.log2(share)).sum(),
        len(set(zip(words, words[1:]))) / w, squeezed / n, lengths.std() / (lengths.mean() + 1),
    ]


def document_statistics(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, stats array<double> and the columns ``also`` of every row."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            stats = [statistics(t) for t in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64())), *batch.columns[2:]], ["doc_id", "stats", *also])

    return docs.select("doc_id", "text", *also).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "stats array<double>", *[f"{c} {kinds[c]}" for c in also]]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  # raw scores at which a calibrated step begins
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        f = np.sqrt(2 / FEATURES) * np.cos(z @ self.omega + self.phase)
        return np.hstack([f, np.ones((len(f), 1))])

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated: linear between the middles of the steps, so that the order of raw scores is kept within limits."""
        return np.clip(np.interp(self.raw_scores(stats), self.edges, self.values), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x: the middles of the pools and their means."""
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([w, b * w, a * w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def _sums(rows: DataFrame, part, shapes: str) -> list:
    """One row of sums of each partition, by ``part`` over (stats, label) arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                stats = np.array(batch.column(0).to_pylist())
                got = part(stats, np.array(batch.column(1).to_pylist(), dtype=float))
                total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([t.astype(np.float64).tobytes()]) for t in total], [f"s{i}" for i in range(len(total))])

    return rows.select("stats", "label").mapInArrow(run, shapes).collect()


def _added(rows: list, i: int, shape: tuple[int, ...]) -> np.ndarray:
    # sorted: sums of doubles shouldn't depend on the order in which tasks end
    return sum((np.frombuffer(r[i]).reshape(shape) for r in sorted(rows, key=lambda r: bytes(r[i]))), np.zeros(shape))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, partitions: int = 8) -> Model | None:
    """A model from rows of doc_id and text, and labels of doc_id and label (0 or 1)."""
    labels = labels.select("doc_id", F.col("label").cast("double").alias("label")).where("doc_id is not null and label is not null").distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    known = keyed.select("doc_id", "h").join(labels, "doc_id").distinct()  # narrow; a repeated row counts once
    drawn = stored(known.orderBy(F.xxhash64("doc_id", "h", "label", F.lit("sample")), "doc_id", "h", "label").limit(most_rows), "quality-drawn")
    chosen = keyed.join(F.broadcast(drawn), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "label"])  # most_rows narrow rows
    rows = document_statistics(chosen, "h", "label")
    rows = stored(rows.repartition(partitions, "doc_id", "h").sortWithinPartitions("doc_id", "h", "label"), "quality-rows")
    k = len(STATISTICS)
    got = _sums(rows, lambda s, y: [np.array([len(s)]), s.sum(0), (s * s).sum(0)], "s0 binary, s1 binary, s2 binary")
    if not got:
        return None
    count = _added(got, 0, (1,))[0]
    mean = _added(got, 1, (k,)) / count
    scale = np.sqrt(np.maximum(_added(got, 2, (k,)) / count - mean**2, 0)) + 1e-6
    rng = np.random.default_rng(SEED)
    model = Model(mean, scale, rng.normal(0, 1 / WIDTH / np.sqrt(k / 8), (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(s: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        f = model.features(s)
        return [f.T @ f, f.T @ y]

    d = FEATURES + 1
    got = _sums(rows, normal, "s0 binary, s1 binary")
    a, b = _added(got, 0, (d, d)), _added(got, 1, (d,))
    penalty = RIDGE * count * np.eye(d)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a + penalty, b)

    def bins(s: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        r = model.raw_scores(s)
        at = np.clip(((r + 0.5) * BINS / 2).astype(int), 0, BINS - 1)
        return [np.bincount(at, minlength=BINS), np.bincount(at, y, BINS), np.bincount(at, r, BINS)]

    got = _sums(rows, bins, "s0 binary, s1 binary, s2 binary")
    w, y, x = (_added(got, i, (BINS,)) for i in range(3))
    some = w > 0
    model.edges, model.values = isotonic(x[some] / w[some], y[some] / w[some], w[some])
    return model


def _scores(batch: pa.RecordBatch, model: Model | None) -> np.ndarray:
    stats = np.array([statistics(t) for t in raw(batch, "text")]).reshape(-1, len(STATISTICS))
    return model.scores(stats) if model is not None and len(stats) else np.full(len(stats), 0.5)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and predicted of every row; reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            s = _scores(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted as good (score 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches):
            yield batch.filter(pa.array(_scores(batch, shared.value) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 3) == 1, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> Model | None:
    """The contract's learning: ``labels.quality`` of rows that aren't held out."""
    taught = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out(F.col("doc_id")))
    return train(docs, taught, most_rows)


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000) -> DataFrame:
    scored = score(docs, fit_documents(docs, labels, most_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
