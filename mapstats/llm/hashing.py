"""Word and shingle hashes in numpy, and streams of sorted rows cut at key boundaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

KNOWN_WORDS = 100_000
U = np.uint64


class _Words(dict):
    """64-bit hash of a word; starts afresh when full."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h
        return h


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the splitmix64 steps)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.full(n, (0x9E3779B97F4A7C15 * (seed * 2 + 1)) & 0xFFFFFFFFFFFFFFFF, dtype=U)
    for i in range(k):
        out = out * U(0x100000001B3) + hashes[i : i + n]
        out ^= out >> U(29)
    return mix(out)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct hashes, sorted, of the k-word shingles of a text with A-Z lower-cased; of the whole
    sequence where it has fewer words; empty without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=U)
    h = word_hashes(words)
    return grams(h, len(words), seed=len(words)) if len(words) < k else np.unique(grams(h, k))


def shingle_set(text: str | None, k: int) -> set[bytes]:
    """The same shingles as themselves, not as hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables in which no key goes on in the next one; rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if keys[0] == keys[-1] and held and held[-1].column(key)[-1] == keys[0]:
            held.append(batch)
            continue
        k = keys.to_numpy(zero_copy_only=False)
        last = int(np.argmax(k == k[-1])) if k[0] != k[-1] else 0
        held.append(batch.slice(0, last))
        whole = pa.Table.from_batches([b for b in held if b.num_rows]) if any(b.num_rows for b in held) else None
        if whole is not None and (last or held[0].column(key)[0] != keys[0]):
            yield whole
            held = [batch.slice(last)]
        else:
            held = [b for b in held if b.num_rows] + [batch.slice(last)]
    if held and any(b.num_rows for b in held):
        yield pa.Table.from_batches([b for b in held if b.num_rows])


def pieces(batches: Iterable[pa.RecordBatch], key: str, most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole groups of rows sorted by key (False), and pieces, one after the other, of single
    groups of more rows than most (True)."""
    held: list[pa.RecordBatch] = []
    n, last, going = 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        at = int(np.searchsorted(k, last, side="right")) if last is not None and k[0] == last else 0
        if at:
            held.append(batch.slice(0, at))
            n += at
        if n and (going or n > most):
            yield pa.Table.from_batches(held), True
            held, n, going = [], 0, True
        if at < len(k):
            cut = int(np.searchsorted(k, k[-1], side="left"))
            held.append(batch.slice(at, cut - at))
            if n + cut - at:
                yield pa.Table.from_batches(held), False
            held, n, last, going = [batch.slice(cut)], len(k) - cut, k[-1], False
    if n:
        yield pa.Table.from_batches(held), going or n > most
