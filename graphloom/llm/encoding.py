"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Method: two tiers. Pre-tokens (the public split pattern) that are themselves in
the vocabulary are resolved by a minimal perfect hash: hash, displace and check,
computed for all new pre-tokens of a batch at once. The rest are merged with a
heap over a linked list of bytes, n log n in the pre-token's length, so that a
run of a million letters is no quadratic case. Resolved pre-tokens are remembered
per Python worker up to a bound in bytes.

Defined cases: null and empty texts give the empty list; the strings of special
tokens are ordinary text; unpaired surrogates cannot occur in Spark's strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources import spread

#: Bytes of pre-tokens that one worker remembers before it forgets all and starts anew.
MEMO_BYTES = 32_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEYS_PER_BUCKET = 4


def default_vocabulary() -> tuple[str, str]:
    """(path of byte_bpe_50k's rank file, the split pattern) of the installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, over all bytes at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    each = _mix((data + np.uint64(1)) * _BASE + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
    return _mix(total[starts + sizes] - total[starts] + sizes.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash of `keys`: n keys in n slots, found by hash and displacement."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // _KEYS_PER_BUCKET)
        h = _hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(counts) - counts
        self.displace = np.zeros(self.buckets, np.uint64)
        self.key_at = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-counts, kind="stable").tolist():
            if not counts[b]:
                break
            own = order[starts[b] : starts[b] + counts[b]]
            d0 = np.uint64(0)
            while True:
                slots = self._slots(h[own][None, :], (d0 + tries)[:, None])
                good = free[slots].all(1)
                if len(own) > 1:
                    srt = np.sort(slots, 1)
                    good &= (srt[:, 1:] != srt[:, :-1]).all(1)
                hit = np.flatnonzero(good)
                if len(hit):
                    break
                d0 += np.uint64(256)
            k = hit[0]
            self.displace[b] = d0 + tries[k]
            self.key_at[slots[k]] = own
            free[slots[k]] = False

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (_mix(h ^ (d * _BASE)) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The key number that each word can only be, if it is a key at all."""
        h = _hashes(words)
        return self.key_at[self._slots(h, self.displace[(h % np.uint64(self.buckets)).astype(np.int64)])]


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by merging: lowest rank first, leftmost among equals."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the part that starts here; -1 if none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if mid < 0 or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, -1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Texts to ids by the rank file `path` and split `pattern`."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.keys = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), np.int64, len(self.ranks))
        self.hash = PerfectHash(self.keys)
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.memo_bytes = 0

    def learn(self, words: list[str]) -> None:
        """Resolve new pre-tokens: by the perfect hash, else by merging."""
        raw = [w.encode("utf-8") for w in words]
        for w, b, k in zip(words, raw, self.hash.lookup(raw).tolist()):
            self.memo[w] = (int(self.ids[k]),) if self.keys[k] == b else tuple(merge_bytes(b, self.ranks))
            self.memo_bytes += 60 + 5 * len(b)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo, self.memo_bytes = {}, 0
        pieces = [self.split(t) if t else () for t in texts]
        memo = self.memo
        new = [w for w in dict.fromkeys(w for p in pieces for w in p) if w not in memo]
        if new:
            self.learn(new)
        flat: list[int] = []
        offsets = np.zeros(len(texts) + 1, np.int64)
        for i, p in enumerate(pieces):
            for w in p:
                flat += memo[w]
            offsets[i + 1] = len(flat)
        return offsets, np.array(flat, np.int32)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path, pattern)


#: Characters of text that are encoded at once.
SLICE_CHARS = 1_000_000


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    texts, first, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        t = t.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= SLICE_CHARS:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's whole text."""
    own_path, own_pattern = (path, pattern) if path and pattern else default_vocabulary()
    use = (path or own_path, pattern or own_pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*use)
        for batch in batches:
            for first, texts in _slices(batch, 1):
                offsets, ids = coder.encode_batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), lists], [key, "ids"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens) of each row's whole text; the ids stay in the worker."""
    own_path, own_pattern = (path, pattern) if path and pattern else default_vocabulary()
    use = (path or own_path, pattern or own_pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(*use)
        for batch in batches:
            for first, texts in _slices(batch, 1):
                offsets, _ = coder.encode_batch(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(np.diff(offsets), pa.int64())], [key, "n_tokens"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint")
