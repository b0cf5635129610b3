"""Byte-level BPE: token counts with a whole-token shortcut, and exact linear-time encoding.

Counting looks every pre-token up in the set of vocabulary strings proved to encode alone
as one token; only the others run through the merges. The proof is made once, on the driver.
Encoding walks over the longest vocabulary matches that an Aho-Corasick automaton finds,
stepping back to shorter ones until every neighbouring pair is one that the merges leave as
it is; the result equals that of the merges. Decoding gathers bytes through an offset table.

No pre-token reaches from anything but white space into a space or a line feed, so a text is
cut there first, and workers remember what they made of a part: at most 2 * CACHE of them, none longer than LONGEST characters. Texts with other white space at such a cut, with
added tokens, or of over PIECE characters go through the pattern as a whole.

Defined results: a null text counts as empty (0 tokens, the digest of no bytes). Empty
tables give empty tables. Rows are independent, so repeated ids, ties and repeated rows
stay as they are. Other columns, of any name, are left out of the result. Texts are never
cut; long ones are pre-tokenised piecewise.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced, tidy

#: The pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parts of texts, and pre-tokens, that a worker keeps in the newer half of what it remembers.
CACHE = 400_000
PIECES = 100_000
LONGEST = 64
ROWS = 500  # documents whose ids are held at once
PIECE = 1_000_000
LINES = re.compile(r"(\n+)")
SPACE = regex.compile(r"\s")


def _byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte: itself where printable, else the next free code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one vocabulary file (the text of a tokenizer.json)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        sym = _byte_symbols()
        self.ids: dict[bytes, int] = {bytes(sym[c] for c in s): i for s, i in spec["model"]["vocab"].items()}
        added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for s, i in self.ids.items():
            self.strings[i] = s
        for s, i in added.items():
            self.strings[i] = s.encode()
        self.merged: dict[tuple[int, int], int] = {}
        self.first: dict[tuple[int, int], int] = {}  # rank of a pair
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = (bytes(sym[c] for c in p) for p in (pair if isinstance(pair, list) else pair.split(" ")))
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged[i, j] = k
            self.first[i, j] = n
            self.rank[k] = n
            self.halves.setdefault(k, (i, j))
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        self.added = added
        self._added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._pre = regex.compile(PRE_TOKEN)
        self._whole: set[str] | None = None
        self._matcher: ahocorasick.Automaton | None = None
        self._fits: dict[int, bool] = {}

    # --- pre-tokens ---

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pre-tokens, and the id of each added token between them."""
        for part in self._added.split(text) if self._added else [text]:
            if part in self.added:
                yield self.added[part]
            elif len(part) <= PIECE:
                yield self._pre.findall(part)
            else:
                found = (m[0] for m in self._pre.finditer(part))
                while piece := list(islice(found, PIECE)):
                    yield piece

    # --- merges, for counts and for the proof ---

    def merge(self, raw: bytes) -> list[int]:
        """Apply the merges, lowest rank and leftmost first: a list of the neighbouring pairs' ranks for
        short pieces, a heap for long ones."""
        if len(raw) <= LONGEST:
            ids, first, merged, never = [self.byte_id[b] for b in raw], self.first, self.merged, len(self.first)
            ranks = [first.get(p, never) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (low := min(ranks)) < never:
                i = ranks.index(low)
                ids[i : i + 2] = [merged[ids[i], ids[i + 1]]]
                del ranks[i]
                if i:
                    ranks[i - 1] = first.get((ids[i - 1], ids[i]), never)
                if i < len(ranks):
                    ranks[i] = first.get((ids[i], ids[i + 1]), never)
            return ids
        tok: list[int | None] = [self.byte_id[b] for b in raw]
        n, rank, merged = len(raw), self.rank, self.merged
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[k], i, k) for i in range(n - 1) if (k := merged.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            if tok[i] is None or (j := right[i]) >= n or merged.get((tok[i], tok[j])) != k:
                continue
            tok[i], tok[j] = k, None
            right[i] = r = right[j]
            if r < n:
                left[r] = i
                if (x := merged.get((k, tok[r]))) is not None:
                    heapq.heappush(heap, (rank[x], i, x))
            if (p := left[i]) >= 0 and (x := merged.get((tok[p], k))) is not None:
                heapq.heappush(heap, (rank[x], p, x))
        return [t for t in tok if t is not None]

    @property
    def whole(self) -> set[str]:
        """Vocabulary strings that the merges turn into exactly their own token."""
        if self._whole is None:
            self._whole = set()
            for raw, i in self.ids.items():
                try:
                    s = raw.decode()
                except UnicodeDecodeError:
                    continue
                if self.merge(raw) == [i]:
                    self._whole.add(s)
        return self._whole

    # --- backtracking encoder ---

    @property
    def matcher(self) -> ahocorasick.Automaton:
        if self._matcher is None:
            self._matcher = ahocorasick.Automaton()
            for raw, i in self.ids.items():
                self._matcher.add_word(raw.decode("latin-1"), (len(raw), i))
            self._matcher.make_automaton()
            self.shorter: list[int | None] = [None] * len(self.strings)
            for raw, i in self.ids.items():
                self.shorter[i] = next((k for n in range(len(raw) - 1, 0, -1) if (k := self.ids.get(raw[:n])) is not None), None)
        return self._matcher

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when both are encoded as neighbours: undo the merges of both,
        latest first, and look for a pair across the seam that would have merged before."""
        key = a << 32 | b
        if (known := self._fits.get(key)) is not None:
            return known
        rank, halves, first = self.rank, self.halves, self.first
        bound, x, y, ok = 1 << 40, a, b, True
        rx, ry = rank.get(a, -1), rank.get(b, -1)
        while True:
            if first.get((x, y), bound) < bound:
                ok = False
                break
            if rx < 0 and ry < 0:
                break
            # The later merge is undone first; on the right, one of equal rank came after the left one.
            if rx > ry:
                bound, x = rx, halves[x][1]
                rx = rank.get(x, -1)
            else:
                bound, y = ry + 1, halves[y][0]
                ry = rank.get(y, -1)
        if len(self._fits) >= 2 * CACHE:
            self._fits.clear()
        self._fits[key] = ok
        return ok

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        n, text, fits = len(raw), raw.decode("latin-1"), self.fits
        at, out = 0, []
        for end, (size, i) in self.matcher.iter_long(text):  # longest matches, one after the other
            if end + 1 - size != at or (out and not fits(out[-1], i)):
                break
            out.append(i)
            at = end + 1
        if at == n:
            return out
        strings, longest = self.strings, self.matcher.iter_long
        dead = bytearray(n + 1)
        tok = next(longest(text, at))[1][1]
        while at < n:
            end = at + len(strings[tok])
            if not dead[end] and (not out or fits(out[-1], tok)):
                out.append(tok)
                at = end
                if at < n:
                    tok = next(longest(text, at))[1][1]
                continue
            less = self.shorter[tok]
            if less is not None:
                tok = less
            else:
                dead[at] = 1
                tok = out.pop()
                at -= len(strings[tok])
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text):
            if isinstance(piece, int):
                out.append(piece)
            else:
                for p in piece:
                    out += self.encode_piece(p.encode())
        return out

    # --- decoding ---

    @property
    def offsets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All token bytes in one buffer, with each token's start and length."""
        if not hasattr(self, "_offsets"):
            sizes = np.array([len(s) for s in self.strings], dtype=np.int64)
            self._offsets = np.frombuffer(b"".join(self.strings), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes
        return self._offsets

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8, with the replacement character where tokens end within one."""
        buffer, start, size = self.offsets
        out = []
        for k in range(0, len(ids), PIECE):
            part = ids[k : k + PIECE]
            n = size[part]
            ends = np.cumsum(n)
            where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[part] - ends + n, n)
            out.append(buffer[where].tobytes())
        return b"".join(out).decode("utf-8", "replace").encode()

    def decode(self, ids: np.ndarray) -> str:
        return self.decoded(ids).decode()


_known: dict[str, Bpe] = {}


def tables(source: str) -> Bpe:
    """One set of tables per worker and vocabulary."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _known:
        _known[key] = Bpe(source)
    return _known[key]


class _Known(dict):
    """What was made of a string, in two halves: when the newer one is full it becomes the older one,
    from which strings in use come back."""

    def __init__(self, make: Callable[[str], object], most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, s: str):
        value = self.older.get(s, self)
        if value is self:
            value = self.make(s)
        if len(s) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[s] = value
        return value


class Parts:
    """The values of a text's parts, in order: made from those of pre-tokens by make and joined by join."""

    def __init__(self, bpe: Bpe, make: Callable[[str], object], of_id: Callable[[int], object], join: Callable[[list], object]):
        self.bpe, self.make, self.of_id, self.join = bpe, make, of_id, join
        self.pieces = _Known(make, PIECES)
        self.heads, self.tails = _Known(lambda s: self._part(s, ""), PIECES), _Known(lambda s: self._part(s, " "), CACHE)

    def _part(self, s: str, before: str):
        """The value of a part after a space or a line's start; None where the cut was wrong."""
        if s.isascii():  # words and what ends them need no pattern
            if s.isalpha():
                return self.make(before + s)
            if s[:-1].isalpha() and s[-1] in ".,;:!?":
                return self.join([self.pieces[before + s[:-1]], self.pieces[s[-1]]])
        if not s or s[0].isspace() or s[-1].isspace() or SPACE.match(s[0]) or SPACE.match(s[-1]):
            return None
        return self.join([self.pieces[p] for p in self.bpe._pre.findall(before + s)])

    def of(self, text: str) -> list:
        if len(text) <= PIECE and not (self.bpe._added and self.bpe._added.search(text)):
            out: list = []
            lines = LINES.split(text)
            last = len(lines) - 1
            for k, line in enumerate(lines):
                if k % 2:  # line feeds: the last one stands alone if a line follows
                    n = len(line) - (k + 1 < last or lines[last] != "")
                    out += [self.pieces[x] for x in ("\n" * n, "\n" * (len(line) - n)) if x]
                elif line:
                    head, *tail = line.split(" ")
                    out.append(self.heads[head])
                    out += map(self.tails.__getitem__, tail)
            if None not in out:
                return out
        return [x for p in self.bpe.pieces(text) for x in ([self.of_id(p)] if isinstance(p, int) else map(self.pieces.__getitem__, p))]


def counted(bpe: Bpe) -> Parts:
    """Token counts: 1 where a pre-token is proved whole, else by the merges."""
    return Parts(bpe, lambda p: 1 if p in bpe.whole else len(bpe.merge(p.encode())), lambda _: 1, sum)


def coded(bpe: Bpe) -> Parts:
    """Ids as little-endian bytes."""
    return Parts(bpe, lambda p: array("I", bpe.encode_piece(p.encode())).tobytes(), lambda i: array("I", [i]).tobytes(), b"".join)


@tidy
def count_batches(batches: Iterable[pa.RecordBatch], source: str, whole: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    bpe = tables(source)
    if bpe._whole is None:
        bpe._whole = set(whole)
    counts = bpe.__dict__.setdefault("counts", counted(bpe))
    for batch in batches:
        sizes, tokens = [], []
        for text in batch.column("text"):
            t = text.as_py() or ""
            sizes.append(len(t.encode()))
            tokens.append(sum(counts.of(t)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


@tidy
def code_batches(batches: Iterable[pa.RecordBatch], source: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = tables(source)
    codes = bpe.__dict__.setdefault("codes", coded(bpe))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    for batch in sliced(batches, ROWS):
        n, ids_digest, text_digest, kept = [], [], [], []
        for text in batch.column("text"):
            code = b"".join(codes.of(text.as_py() or ""))
            ids = np.frombuffer(code, dtype="<u4")
            n.append(len(ids))
            ids_digest.append(hashlib.sha256(code).hexdigest())
            text_digest.append(hashlib.sha256(bpe.decoded(ids)).hexdigest())
            if with_ids:
                kept.append(ids.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())] + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names=names)


def _vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    source = _vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((source, sorted(tables(source).whole)))  # one file of fixed size
    return _texts(docs).mapInArrow(lambda b: count_batches(b, *shared.value, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode every text, decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    return _texts(docs).mapInArrow(lambda b: code_batches(b, shared.value, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
