"""Language identification by a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes (all of them; the last is padded). A window's bytes are
embedded; filters of several widths slide over them; each filter's largest response over the window, cut at zero, goes
into a softmax over the languages seen in learning. A text's answer is the language of the largest mean probability of its windows.

Scale. Prediction only maps the documents; the model is a few thousand floats. Learning uses a bounded sample of labelled
rows (about ``most_rows``, spread over the languages), all windows of each. The windows are dealt to parts of bounded size that learn on the
executors; a round averages their models, which is all that reaches the driver.

Defined results. ``und`` with score 0 for null texts and texts without a letter; with no labelled row that is every
text. Texts of any length are read whole, a block of windows at a time. Of languages with equal mean probability the first by name is
taken. Repeated rows and null ids stay, an empty table gives no rows, columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import by_batch, id_remainder, raw, stored

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 14
WIDEST = max(WIDTHS)
#: Windows that are applied at once.
BLOCK = 64


def windows_of(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes; the last window is padded with zeros."""
    a = np.frombuffer(text, np.uint8)
    n = -(-len(a) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(a)] = a
    return out.reshape(n, WINDOW)


class ByteCnn:
    """Embedding, filters of several widths as one matrix with zeros beyond a filter's width, max pooling, softmax."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        k, f = WIDEST * EMBED, FILTERS * len(WIDTHS)
        self.mask = np.zeros((k, f), np.float32)
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": (rng.normal(0, 0.4, (k, f)) * self.mask).astype(np.float32),
            "bias": np.zeros(f, np.float32),
            "out": rng.normal(0, 0.1, (f, len(languages))).astype(np.float32),
            "out_bias": np.zeros(len(languages), np.float32),
        }

    def packed(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in sorted(self.p))

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = flat[at : at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        """(n * places, WIDEST * EMBED): the embedded bytes at each place of each window."""
        e = self.p["embed"][windows]
        n, places = len(windows), WINDOW - WIDEST + 1
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, places, WIDEST * EMBED), (s[0], s[1], s[2]))
        return view.reshape(n * places, WIDEST * EMBED)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), BLOCK):
            block = windows[at : at + BLOCK]
            r = (self._patches(block) @ self.p["filters"]).reshape(len(block), -1, self.mask.shape[1])
            pooled = np.maximum(r.max(axis=1) + self.p["bias"], 0)
            out[at : at + BLOCK] = _softmax(pooled @ self.p["out"] + self.p["out_bias"])
        return out

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on cross-entropy; only the place of each filter's largest response passes a gradient back."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BLOCK):
                rows = order[at : at + BLOCK]
                grads = self._gradients(windows[rows], labels[rows])
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        n, f = len(windows), self.mask.shape[1]
        patches = self._patches(windows)
        r = (patches @ self.p["filters"]).reshape(n, -1, f)
        best = r.argmax(axis=1)
        top = np.take_along_axis(r, best[:, None, :], 1)[:, 0, :] + self.p["bias"]
        pooled = np.maximum(top, 0)
        d = _softmax(pooled @ self.p["out"] + self.p["out_bias"])
        d[np.arange(n), labels] -= 1
        d /= n
        back = (d @ self.p["out"].T) * (top > 0)
        chosen = patches.reshape(n, -1, WIDEST * EMBED)[np.arange(n)[:, None], best]  # n, f, k
        embed = np.zeros_like(self.p["embed"])
        to_patch = back[:, :, None] * self.p["filters"].T[None]  # n, f, k
        for j in range(WIDEST):
            np.add.at(embed, windows[np.arange(n)[:, None], best + j], to_patch[:, :, j * EMBED : (j + 1) * EMBED])
        return {
            "filters": np.einsum("nf,nfk->kf", back, chosen) * self.mask,
            "bias": back.sum(0), "out": pooled.T @ d, "out_bias": d.sum(0), "embed": embed,
        }


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(id_remainder(doc_id, 4) == 2, F.lit(False))


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text[:200].decode("utf-8", "ignore"))) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def _sample(labelled: DataFrame, most_rows: int) -> DataFrame:
    """h, text and lang of about ``most_rows`` different rows, as evenly over the languages as their numbers allow.

    Rows are chosen by a hash of id and text, so that rows which share an id (or have none) are chosen apart, and repeated rows once.
    """
    counts = {r.lang: r["count"] for r in labelled.where("lang is not null").groupBy("lang").count().collect()}  # one row per language
    share, left, open_ = {}, most_rows, sorted(counts, key=lambda k: (counts[k], k))
    for i, lang in enumerate(open_):  # what small languages leave goes to the larger ones
        share[lang] = min(1.0, left / (len(open_) - i) / counts[lang])
        left -= share[lang] * counts[lang]
    rows = labelled.select("text", "lang", F.xxhash64("doc_id", "text", F.lit("sample")).alias("h")).where("lang is not null and length(text) > 0")
    if not share:
        return rows.limit(0)
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)))])
    return rows.where(F.pmod("h", F.lit(1 << 30)) < limit[F.col("lang")]).dropDuplicates(["h", "lang"])


def _learner(shared, code: dict[str, int], k: int):
    """One part's pass of round ``k`` over its windows, from the broadcast model."""

    def learn(table):
        net: ByteCnn = shared.value
        rows = sorted(zip(table.column("w").to_pylist(), map(code.get, table.column("lang").to_pylist()), strict=True))
        windows, labels = np.stack([np.frombuffer(w, np.uint8) for w, _ in rows]), np.array([c for _, c in rows])
        net.fit(windows, labels, epochs=1, rate=0.006 / (1 + k / 2), seed=k)
        return pa.table({"part": table.column("part")[:1], "n": pa.array([len(rows)], pa.int64()), "weights": pa.array([net.packed()], pa.binary())})

    return learn


def train(labelled: DataFrame, most_rows: int = 2000, rounds: int = 8, part_windows: int = 4096) -> ByteCnn | None:
    """A model from the rows of doc_id, text and lang; null and empty texts and null languages are left out.

    All windows of about ``most_rows`` rows are dealt to parts of about ``part_windows`` windows. In each of ``rounds`` rounds every part
    takes the model through its windows once, and the models are averaged by the parts' windows. Only models reach the driver.
    """
    spark = labelled.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches, 1 << 20):
            keys, places, langs, parts = [], [], [], []
            for text, lang, h in zip(raw(batch, "text"), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if has_letter(text):
                    found = windows_of(text)
                    parts += [w.tobytes() for w in found]
                    places += range(len(found))
                    langs += [lang] * len(found)
                    keys += [h] * len(found)
            columns = [pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["h", "place", "lang", "w"])

    windows = stored(_sample(labelled, most_rows).select("text", "lang", "h").mapInArrow(cut, "h long, place long, lang string, w binary"), "language-windows")
    sizes = {r.lang: r["count"] for r in windows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    model = ByteCnn(sorted(sizes))
    code = {k: i for i, k in enumerate(model.languages)}
    parts = max(1, round(sum(sizes.values()) / part_windows))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("h", "place"), F.lit(parts)))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        got = dealt.groupBy("part").applyInArrow(_learner(shared, code, k), "part long, n long, weights binary").collect()
        got.sort(key=lambda r: r.part)  # sums of floats shouldn't depend on the order in which tasks end
        model.unpack(sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * r.n for r in got) / sum(r.n for r in got))
        shared.destroy()
    return model


def predict(docs: DataFrame, model: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred and score (mean probability over all windows) of every row; reads doc_id and text only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteCnn | None = shared.value
        for batch in by_batch(batches, 4 << 20):
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            rows, parts = [], []
            for i, text in enumerate(raw(batch, "text")):
                if net is not None and text and has_letter(text):
                    parts.append(windows_of(text))
                    rows.append(i)
            if rows:
                probability = net.probabilities(np.concatenate(parts)).astype(np.float64)
                starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                mean = np.add.reduceat(probability, starts, axis=0) / np.array([len(p) for p in parts])[:, None]
                for i, m in zip(rows, mean, strict=True):
                    langs[i], scores[i] = net.languages[int(m.argmax())], min(1.0, float(m.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def identify(docs: DataFrame, most_rows: int = 2000) -> DataFrame:
    """The contract: learn from the rows that aren't held out, predict all."""
    model = train(docs.where(~held_out(F.col("doc_id"))), most_rows)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
