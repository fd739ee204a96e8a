"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier 1 is a minimal perfect hash over the vocabulary: a pre-token that is itself in the vocabulary costs one hash, one
displacement and one comparison. Tier 2 merges the bytes of other pre-tokens: linked bytes and a heap of (rank, place), so
a pre-token of n bytes costs n log n steps, whatever its length.

Text is cut at spaces after a character that isn't white space, where no match of ``CUT_PATTERN`` can reach across, and pre-tokenised
piece by piece with the tokenizer's own pattern; each worker remembers the ids of short pieces in one table of bounded size. A text is
cut for that pattern only.

Scale. Documents are only mapped. The vocabulary file is read on the driver (its size is checked against
``most_bytes``) and broadcast; it is a parameter and never part of this repository.

Defined results. Null and empty texts have no ids and decode to empty bytes. Texts and pre-tokens of any length are encoded whole. Of equal
pairs the leftmost merges first. Repeated rows stay; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm.common import by_batch, raw

_M64 = (1 << 64) - 1

#: The pattern for which cuts before spaces are sure (a fixed value); with another one texts are pre-tokenised whole.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space after a character that isn't white space.
_CUT = re.compile(r" (?<=\S )")


def read_ranks(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> list[bytes]:
    """The tokens of a rank file, by rank. ``path`` is on the driver's machine."""
    with open(path, "rb") as f:
        data = f.read(most_bytes + 1)
    if len(data) > most_bytes:
        raise ValueError(f"{path} has more than {most_bytes} bytes")
    pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, data.splitlines()) if t)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash of byte strings to their place in the list, by hash and displace.

    Keys fall into buckets of about two. Large buckets first, each takes the first displacement that sends all its keys to free
    slots; a bucket of one key names its slot directly (as -1 - slot).
    """

    def __init__(self, keys: list[bytes]):
        self.keys, self.n = keys, len(keys)
        self.buckets = max(1, (self.n + 1) // 2)
        self.shift = np.zeros(self.buckets, dtype=np.int64).tolist()
        self.place = [-1] * self.n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        singles = []
        for b, group in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(group) == 1:
                singles.append((b, group[0][1]))
                continue
            d = 0
            while True:
                d += 1
                slots = [self._slot(h, d) for h, _ in group]
                if len(set(slots)) == len(slots) and all(self.place[s] < 0 for s in slots):
                    break
            self.shift[b] = d
            for s, (_, i) in zip(slots, group, strict=True):
                self.place[s] = i
        free = (s for s in range(self.n) if self.place[s] < 0)
        for (b, i), s in zip(singles, free, strict=False):
            self.shift[b] = -1 - s
            self.place[s] = i

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * 0x9E3779B97F4A7C15)) & _M64) * 0xC2B2AE3D27D4EB4F & _M64) >> 29) % self.n

    def get(self, key: bytes) -> int:
        """The key's place, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = self.place[-1 - d if d < 0 else ((((h ^ (d * 0x9E3779B97F4A7C15)) & _M64) * 0xC2B2AE3D27D4EB4F & _M64) >> 29) % self.n]
        return i if self.keys[i] == key else -1


class ByteBpe:
    """An encoder for one worker.

    Ids are packed (two or four bytes each) and remembered in one table: under the text after its space for what begins with a space,
    under the bytes for other pre-tokens. The table has two generations of ``remember`` entries: a full one becomes the old one, and what is
    met again moves to the new one, so that frequent entries are never thrown away.
    """

    def __init__(self, table: PerfectHash, pattern: str, remember: int = 300_000):
        self.table, self.tokens, self.pattern = table, table.keys, regex.compile(pattern)
        self.cuts = pattern == CUT_PATTERN
        self.longest = max(map(len, self.tokens), default=0)
        self.kind = np.dtype("uint16" if len(self.tokens) <= 1 << 16 else "uint32")
        self.packed = [i.to_bytes(self.kind.itemsize, sys.byteorder) for i in range(len(self.tokens))]
        ranks = {t: i for i, t in enumerate(self.tokens)}
        self.single = [ranks.get(bytes([c]), -1) for c in range(256)]
        self.pairs: dict[int, int] = {}  # the id that two ids merge to, by (left << 32) | right
        for i, t in enumerate(self.tokens):
            for k in range(1, len(t)):
                left, right = ranks.get(t[:k]), ranks.get(t[k:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = i
        self.known: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}
        self.remember = remember

    def _keep(self, key: str | bytes, ids: bytes) -> bytes:
        if len(key) <= 32:
            if len(self.known) >= self.remember:
                self.old, self.known = self.known, {}
            self.known[key] = ids
        return ids

    def _met(self, key: str | bytes) -> bytes | None:
        ids = self.known.get(key)
        if ids is None and (ids := self.old.get(key)) is not None:
            self._keep(key, ids)
        return ids

    def pre_token(self, match: str) -> bytes:
        """Packed ids of one match of the pattern."""
        key = match[1:] if match[0] == " " else match.encode()
        ids = self._met(key)
        if ids is None:
            word = match.encode()
            i = self.table.get(word) if len(word) <= self.longest else -1
            ids = self._keep(key, self.packed[i] if i >= 0 else b"".join(map(self.packed.__getitem__, self.merge(word))))
        return ids

    def merge(self, word: bytes) -> list[int]:
        """Always the pair of lowest rank, the leftmost of equal ones; by a heap over linked bytes.

        A part is known by its first byte; ``after`` and ``before`` link the parts, ``ids`` names them, and ``least`` has the id that a part
        and the next one merge to. A heap entry packs (that id, first byte); it is stale unless ``least`` still says so.
        """
        n, pairs = len(word), self.pairs.get
        ids = list(map(self.single.__getitem__, word))
        if min(ids) < 0:
            raise ValueError("the vocabulary lacks a byte of the text")
        least = [pairs(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        bits = n.bit_length()
        heap = [r << bits | i for i, r in enumerate(least) if r >= 0]
        heapify(heap)
        least.append(-1)
        after, before, low = [*range(1, n + 1)], [*range(-1, n)], (1 << bits) - 1
        while heap:
            entry = heappop(heap)
            i, r = entry & low, entry >> bits
            if least[i] != r:
                continue
            j = after[i]
            end = after[i] = after[j]
            ids[i], ids[j], least[j], least[i] = r, -1, -1, -1
            if end < n:
                before[end] = i
                if (m := pairs(r << 32 | ids[end], -1)) >= 0:
                    least[i] = m
                    heappush(heap, m << bits | i)
            p = before[i]
            if p >= 0:
                m = least[p] = pairs(ids[p] << 32 | r, -1)
                if m >= 0:
                    heappush(heap, m << bits | p)
        return [i for i in ids if i >= 0]

    def piece(self, text: str) -> bytes:
        found = self.pattern.findall(text)
        return self.pre_token(found[0]) if len(found) == 1 else b"".join(map(self.pre_token, found))

    def _unit(self, unit: str) -> bytes:
        """Packed ids of a space and ``unit``."""
        ids = self._met(unit)
        if ids is None:
            found = self.pattern.findall(" " + unit)
            ids = b"".join(map(self.pre_token, found))
            if len(found) == 2:  # longer ones seldom come again, single ones are kept as pre-tokens
                self._keep(unit, ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if not self.cuts:
            return np.frombuffer(self.piece(text), self.kind)
        units = _CUT.split(text)
        got = list(map(self.known.get, units))
        got[0] = self.piece(units[0])
        at = 0
        for _ in range(got.count(None)):
            at = got.index(None, at)
            got[at] = self._unit(units[at])
        return np.frombuffer(b"".join(got), self.kind)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_OWN: dict = {}


def _worker(shared, pattern: str) -> ByteBpe:
    """The worker process's encoder, kept from task to task with the pieces that it remembers."""
    key = (shared._path, pattern)
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = ByteBpe(shared.value, pattern)
    return _OWN[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and token_ids array<int> of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(docs.sparkSession, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared, pattern)
        for batch in by_batch(batches, 4 << 20):
            sizes, flat = [0], []
            for text in raw(batch, "text"):
                ids = bpe.encode(text.decode("utf-8", "replace")) if text else np.zeros(0, np.int32)
                flat.append(ids.astype(np.int32))
                sizes.append(sizes[-1] + len(ids))
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], ["doc_id", "token_ids"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, token_ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of ``encode_documents``."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(encoded.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_batch(batches, 4 << 20):
            texts = [b"".join(map(tokens.value.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, decoded binary")


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass over the documents: the contract's digests, and the ids themselves if asked for.

    Encoding and decoding are ``ByteBpe``'s, as in the two operators above; one pass saves moving the ids between them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(docs.sparkSession, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared, pattern)
        decimal = [b"%d" % i for i in range(len(bpe.tokens))]
        for batch in by_batch(batches, 4 << 20):
            counts, ids_sha, text_sha, flat = [], [], [], [np.zeros(0, np.int32)]
            for text in raw(batch, "text"):
                array = bpe.encode(text.decode("utf-8", "replace")) if text else np.zeros(0, np.int32)
                ids = array.tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    flat.append(array.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat))))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)["doc_id"]
    more = ", token_ids array<int>" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
