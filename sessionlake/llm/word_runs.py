"""Runs: stretches of consecutive words that repeat with a period at least three times, by string synchronising sets.

A run has a smallest period q (words q apart are identical), is at least 3q words long, and no neighbouring word extends it. All of them are found:

Positions. At scale t (2, 4, 8, ...) a word position i is chosen if, among the t-word blocks that start in [i, i + t] and aren't highly
periodic (period t/3 at most), the least hash is that of the block at i or at i + t. The choice depends on the 2t words from i
only, so equal contexts are chosen alike; and any 3t words hold one among their first t, or are highly periodic as a whole.

Periods. A run with 3t <= q < 6t is longer than what its own highly periodic parts can cover, so it has a chosen position
i with i + q chosen too and the same 2t words there. Pairs of chosen positions with equal contexts that are 3t to 6t apart propose their
distance. There are few: equal contexts are more than t/3 apart, since each holds a block that isn't highly periodic.

Highly periodic regions. Periods under ``SMALL`` come from comparing the words with themselves at that lag. The blocks that a scale leaves out are
those inside runs of a period up to t/3, which the smaller scales and lags have found already.

Extension. Both ends of a proposal are found by bisection over prefix hashes; each run is then compared word by word, and should
hashes have collided, its period is looked for by the lag. Of several periods of one stretch the smallest stays. So results are exact.

Scale. A map over documents: no shuffle. Texts are joined into arrays of about ``CHUNK`` words, longest first, with marks
between them that equal no word, and a scale looks at the documents only that are long enough. The work is n log n array steps.

Defined results. A null or empty text, or one of white space, has no words, no runs and the collapsed text "". Texts of any length
are read whole. Null and repeated ids and rows stay as they are, an empty table gives no rows, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import by_batch, mix, raw

TIMES = 3
SMALL = 6
CHUNK = 1 << 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_NONE = np.iinfo(np.uint64).max

RUNS = "array<struct<start:long,length:long,period:long>>"


def lag_runs(words: np.ndarray, period: int) -> np.ndarray:
    """start, end, period of the longest possible stretches with that period, at least ``TIMES`` periods long."""
    if len(words) < TIMES * period:
        return np.empty((0, 3), np.int64)
    same = np.concatenate(([False], words[period:] == words[:-period], [False]))
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + period
    long = ends - starts >= TIMES * period
    return np.stack([starts[long], ends[long], np.full(long.sum(), period)], axis=1)


def synchronising(blocks: np.ndarray, t: int, periodic: np.ndarray | None) -> np.ndarray:
    """The chosen positions of a scale: ``blocks`` are the hashes of its t-word blocks, ``periodic`` marks those to leave out."""
    v = blocks >> np.uint64(1)
    if periodic is not None:
        v[periodic] = _NONE
    least, step = v, 1
    while step < t:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    n = len(v) - t
    least = np.minimum(least[:n], v[t:])
    return np.flatnonzero(((least == v[:n]) | (least == v[t:])) & (least != _NONE))


def proposals(places: np.ndarray, contexts: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, periods): pairs of chosen places with equal contexts, 3t to 6t apart."""
    order = np.lexsort((places, contexts))
    places, contexts = places[order], contexts[order]
    left, lag, found = np.arange(len(places)), 0, []
    while len(left):
        lag += 1
        left = left[left + lag < len(places)]
        apart = places[left + lag] - places[left]
        near = (contexts[left + lag] == contexts[left]) & (apart < 6 * t)
        left, apart = left[near], apart[near]
        found.append((places[left[apart >= 3 * t]], apart[apart >= 3 * t]))
    if not found:
        return places, places
    i, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((i, period))
    i, period = i[order], period[order]
    first = np.append(True, (period[1:] != period[:-1]) | (i[1:] - i[:-1] > 2 * t))[: len(i)]  # contexts that touch lie in one stretch
    return i[first], period[first]


class _Extension:
    """Longest common extensions of pairs of positions by bisection over prefix hashes (wrapping 64-bit arithmetic)."""

    def __init__(self, hashes: np.ndarray):
        self.power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(hashes), _A), dtype=np.uint64)))
        self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * self.power[:-1], dtype=np.uint64)))

    def _bisect(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        p, shift, got = self.prefix, self.power[j - i], np.zeros(len(i), np.int64)
        base_i, base_j = p[i], p[j]
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            trial = got + step
            k = way * np.where(trial <= most, trial, 0)
            same = (p[i + k] - base_i) * shift == p[j + k] - base_j
            got = np.where((trial <= most) & same, trial, got)
            step >>= 1
        return got

    def runs(self, i: np.ndarray, period: np.ndarray) -> np.ndarray:
        """start, end, period around each position that reach the needed length."""
        j = i + period
        start = i - self._bisect(i, j, i, -1)
        end = j + self._bisect(i, j, len(self.prefix) - 1 - j, 1)
        found = np.stack([start, end, period], axis=1)
        return np.unique(found[end - start >= TIMES * period], axis=0)


def find_runs_of(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, end, period (the smallest) of all runs of a sequence of word numbers, by start, then period.

    ``sizes`` are the lengths of the documents in it, longest first; each is followed by a number that occurs nowhere else.
    """
    ends = np.cumsum(sizes + 1)
    found = [lag_runs(words, q) for q in range(1, SMALL)]
    blocks = mix(words.astype(np.uint64) * _A + _B)
    extension, t = None, 1
    while True:
        reach = int(np.searchsorted(-sizes, -TIMES * 3 * t, side="right"))  # documents that have room for a period of 3t
        if not reach:
            break
        n = int(ends[reach - 1])
        blocks = blocks[: n - t + 1]
        twice = mix(blocks[:-t] * _A + mix(blocks[t:] * _C + _B))
        if 6 * t > SMALL:
            places = synchronising(blocks, t, _inside(found, t, len(blocks)))
            i, period = proposals(places, twice[places], t)
            if len(i):
                extension = extension or _Extension(mix(words.astype(np.uint64) * _C + _A))
                runs = extension.runs(i, period)
                right = np.array([np.array_equal(words[s : e - q], words[s + q : e]) for s, e, q in runs.tolist()], bool)
                found.append(runs[right] if len(runs) else runs)
                found += [lag_runs(words, int(q)) for q in np.unique(runs[~right, 2])] if not right.all() else []
        blocks, t = twice, 2 * t
    every = np.unique(np.concatenate(found), axis=0)  # by start, end, period
    if len(every):
        first = np.append(True, (every[1:, :2] != every[:-1, :2]).any(axis=1))
        every = every[first]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _inside(found: list[np.ndarray], t: int, n: int) -> np.ndarray | None:
    """Which t-word blocks have a period of t/3 at most: those inside a run with such a period."""
    runs = np.concatenate(found)
    runs = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    runs = runs[runs[:, 0] < n]
    if not len(runs):
        return None
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, np.minimum(runs[:, 1] - t + 1, n), -1)
    return np.cumsum(change[:-1]) > 0


def runs_of_documents(documents: list[list[bytes]]) -> list[np.ndarray]:
    """start, length, period of the runs of each document (a list of words), by start, then period."""
    numbers: dict[bytes, int] = {}
    order = sorted(range(len(documents)), key=lambda d: -len(documents[d]))
    parts, sizes = [], np.array([len(documents[d]) for d in order], np.int64)
    for k, d in enumerate(order):
        parts += [np.fromiter((numbers.setdefault(w, len(numbers)) for w in documents[d]), np.int64, len(documents[d])), np.array([-1 - k])]
    if not parts:
        return []
    runs = find_runs_of(np.concatenate(parts), sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1
    edges = np.searchsorted(runs[:, 0], np.append(starts, starts[-1] + sizes[-1] + 1))
    out: list[np.ndarray] = [None] * len(documents)
    for k, d in enumerate(order):
        mine = runs[edges[k] : edges[k + 1]]
        out[d] = np.stack([mine[:, 0] - starts[k], mine[:, 1] - mine[:, 0], mine[:, 2]], axis=1)
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run has after its first period, joined by one space."""
    if len(runs):
        kept = np.ones(len(words), bool)
        for start, length, period in runs.tolist():
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
    return b" ".join(words)


def find_runs(docs: DataFrame, least_words: int = 24, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) of at least ``least_words``, and the collapsed text of every row.

    ``rewrite`` may replace the words of a document (given its id) before anything else looks at them.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
        ids, texts, n = [], [], 0
        for batch in batches:
            for part in by_batch([batch], 4 << 20):
                for doc_id, text in zip(part.column(0).to_pylist(), raw(part, "text"), strict=True):
                    words = text.split() if text else []
                    words = rewrite(doc_id, words) if rewrite else words
                    ids.append(doc_id)
                    texts.append(words)
                    n += len(words)
                    if n >= CHUNK:
                        yield ids, texts
                        ids, texts, n = [], [], 0
        if ids:
            yield ids, texts

    kind = dict(docs.dtypes)["doc_id"]
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def noted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for batch in source:
                id_type = batch.schema.field(0).type
                yield batch

        for ids, texts in chunks(noted(batches)):
            found = [r[r[:, 1] >= least_words] for r in runs_of_documents(texts)]
            flat = np.concatenate(found)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(struct))
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            columns = [
                pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(ends, rows),
                pa.array([collapse(t, r) for t, r in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of about every tenth document the words from some place on repeat with some period, as the contract of op12 has it."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def digest(found: DataFrame) -> DataFrame:
    """The columns of op12: the run of the greatest exact exponent (ties: the first) and digests of runs and collapsed text."""
    better = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = found.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute_force(words: list[bytes], least_words: int = 24) -> list[tuple[int, int, int]]:
    """start, length, period of all runs, by trying every period; for tests."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // TIMES + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, TIMES * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())
