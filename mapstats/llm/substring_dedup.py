"""Substring dedup with prefix-partitioned suffix trees over words.

A word sequence of WINDOW words that starts earlier somewhere else (smaller doc_id, or the
same document and an earlier start) is a repeat; every word that a repeat covers is removed.
In the suffix tree of all documents, repeats are the leaves below internal nodes of depth
WINDOW or more, but for each node's earliest leaf. The tree is built in parts:

1. Prefixes. In every run of WINDOW words one run of PREFIX words has the least hash; equal
   runs choose the same one, its anchor. Each batch reports its anchors; those whose prefix
   occurs once in the whole table have no deep node above them and go. Windows that repeat
   within a batch are found in the batch's own subtree, and don't travel: so a passage that
   is in a third of all documents arrives about once a batch.
2. Groups. The suffixes of a prefix form one group if they are at most GROUP. Else they are
   told apart by longer prefixes, their first words: LONGER after LONGER, as counts ask for,
   and at last the whole window, where a group of any size has one node.
3. Subtrees. A group's suffixes arrive in the order of their documents and become a subtree:
   their order by words, by doubling, and the common-prefix lengths of neighbours. Runs of
   neighbours with WINDOW words or more in common are the deep internal nodes. All leaves of
   such a node but the earliest are repeats; neighbouring ones make maximal repeats (spans).
   Of a group of more than SUBTREE rows one leaf a node is remembered from piece to piece.

Hashes choose prefixes, groups and what may repeat in a batch, which only ever brings more
together; subtrees compare the words themselves, so results are exact.

Defined results: a null text has no words. A null doc_id comes after all others. Rows equal
in doc_id and text are one document and have the same result; rows that share an id only are
ordered by a hash of their texts. Documents of fewer than WINDOW words stay as they are. An
empty table gives an empty table. Results hold their own columns only; deduped() has those of
its input, with the kept words joined by one space where any was removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets, masked, ship, tidy, written
from .hashing import U, grams, mix, pieces, signed, word_hashes

WINDOW = 20
PREFIX = 6
LONGER = (10, 15)
GROUP = 16_384
SUBTREE = 65_536  # rows of a group that are held at once
PARTS = 256  # keys that the texts of one id are dealt to
CHUNK = 1_000_000  # words whose windows are compared at once
LAST = (1 << 63) - 1  # stands for a null doc_id


def _anchors(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes; of each window, the place of the one that is its anchor (never falling)."""
    g = grams(h, prefix, seed=1)
    w = window - prefix + 1
    if len(g) < w:
        return g, np.zeros(0, dtype=np.int64)
    return g, np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) + np.arange(len(g) - w + 1)


def _ranges(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)


def _part(doc: int, th: int) -> int:
    """Which of an id's texts: all of th without an id, else one of PARTS."""
    return th if doc == LAST else th % PARTS


class Subtree:
    """Suffix tree of rows of words, joined by one space: its suffixes of at least window words in order,
    and its internal nodes of that depth, told by the common-prefix lengths of neighbours. Rows of
    different groups have nothing in common. Words are numbered by place, row after row.

    start: each row's first place. repeat: of each place, whether a node as deep has an earlier leaf.
    """

    def __init__(self, rows: pa.Array, group: np.ndarray, window: int):
        split = pc.split_pattern(rows, b" ")
        size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(size) - size
        codes = split.flatten().dictionary_encode()
        n = len(codes)
        left = np.repeat(self.start + size, size) - np.arange(n)  # words to the end of the row
        code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rank = np.unique(np.repeat(group, size) * len(codes.dictionary) + code, return_inverse=True)[1].astype(np.int64)
        ranks, k = [], 1
        while k <= window:  # ranks of all runs of k words, cut at the ends of rows
            ranks.append((k, rank))
            then = np.zeros(n, dtype=np.int64)
            on = np.flatnonzero(left > k)
            then[on] = rank[on + k] + 1
            rank = np.unique(rank * (n + 1) + then, return_inverse=True)[1].astype(np.int64)
            k *= 2
        self.leaves = np.flatnonzero(left >= window)
        self.leaves = self.leaves[np.argsort(rank[self.leaves], kind="stable")]
        i, j = self.leaves[:-1], self.leaves[1:]
        common = np.zeros(len(i), dtype=np.int64)
        for k, rank in reversed(ranks):
            same = (np.minimum(left[i], left[j]) - common >= k) & (rank[np.minimum(i + common, n - 1)] == rank[np.minimum(j + common, n - 1)])
            common += k * same
        self.repeat = np.zeros(n, dtype=bool)
        if len(self.leaves):
            opens = np.concatenate([[True], common < window])
            earliest = np.minimum.reduceat(self.leaves, np.flatnonzero(opens))
            self.repeat[self.leaves] = self.leaves != earliest[np.cumsum(opens) - 1]


@tidy
def anchor_batches(batches: Iterable[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, doc, th, a, b): an anchor at word a (b is -1), or repeats that start at words a to b."""
    for batch in batches:
        ids, marks, texts = (batch.column(c) for c in ("doc", "th", "text"))
        order = sorted(range(len(batch)), key=lambda i: (ids[i].as_py(), marks[i].as_py()))
        chunk: list[tuple[int, int, list[bytes], np.ndarray]] = []
        size, last = 0, None
        for i in order:
            key = (ids[i].as_py(), marks[i].as_py())
            if key == last:
                continue
            last = key
            words = (texts[i].as_py() or "").encode().split()
            if len(words) >= window:
                chunk.append((*key, words, word_hashes(words)))
                size += len(words)
            if size >= CHUNK:
                yield _reported(chunk, window, prefix)
                chunk, size = [], 0
        if chunk:
            yield _reported(chunk, window, prefix)


def _reported(chunk: list[tuple[int, int, list[bytes], np.ndarray]], window: int, prefix: int) -> pa.RecordBatch:
    hashes = [grams(h, window, seed=2) for *_, h in chunk]
    _, which, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    often = times[which] > 1
    at, rows, places = 0, [], []
    for i, ((_, _, words, _), w) in enumerate(zip(chunk, hashes, strict=True)):
        for a, b in _ranges(often[at : at + len(w)]):
            rows.append(b" ".join(words[a : b + window]))
            places.append((i, a, b))
        at += len(w)
    flags = [np.zeros(len(w), dtype=bool) for w in hashes]
    if rows:
        tree = Subtree(pa.array(rows, pa.large_binary()), np.zeros(len(rows), dtype=np.int64), window)
        for (i, a, b), start in zip(places, tree.start.tolist(), strict=True):
            flags[i][a : b + 1] = tree.repeat[start : start + b - a + 1]
    cols: list[list[np.ndarray]] = [[], [], [], [], []]

    def add(g, doc, th, a, b):
        for c, v in zip(cols, (g, np.full(len(g), doc), np.full(len(g), th), a, b), strict=True):
            c.append(v.astype(np.int64) if v.dtype != U else signed(v))

    for (doc, th, _, h), f in zip(chunk, flags, strict=True):
        g, anchor = _anchors(h, window, prefix)
        a = np.unique(anchor[~f])
        add(g[a], doc, _part(doc, th), a, np.full(len(a), -1))
        spans = np.array(list(_ranges(f)), dtype=np.int64).reshape(-1, 2).copy()
        # Any key does for these rows, which only pass through; a hash of their place spreads them.
        place = np.full(len(spans), doc).astype(np.int64).view(U) * U(0x9E3779B97F4A7C15)
        add(mix(spans[:, 0].astype(U) + place), doc, th, spans[:, 0], spans[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["g", "doc", "th", "a", "b"])


def prefix_batches(batches: Iterable[pa.RecordBatch], group: int) -> Iterator[pa.RecordBatch]:
    """Places of prefixes that occur twice or more, with b = -1, or -2 where the group is too large."""
    for t, large in pieces(batches, "g", group):
        g, a, b, doc, th = (t.column(c).to_numpy() for c in ("g", "a", "b", "doc", "th"))
        anchor = b == -1
        if large:
            b = np.where(anchor, -2, b)
        else:
            _, which, n = np.unique(g[anchor], return_inverse=True, return_counts=True)
            keep = ~anchor
            keep[anchor] = n[which] > 1
            doc, th, a, b = (x[keep] for x in (doc, th, a, b))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, th, a, b)], names=["doc", "th", "a", "b"])


def _windows(batch: pa.RecordBatch, window: int, prefix: int) -> Iterator[tuple[int, int, list[bytes], int, int, int, int]]:
    """(doc, th, words, prefix length, key, first and last window) of every place found in a document."""
    for doc, th, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "text", "found")), strict=True):
        words = (text or "").encode().split()
        if len(words) < window:
            continue
        h = word_hashes(words)
        g, anchor = _anchors(h, window, prefix)
        longer: dict[int, np.ndarray] = {}
        for e in found:
            a, n = e["a"], e["n"]
            if n == prefix:
                lo, hi = int(np.searchsorted(anchor, a)), int(np.searchsorted(anchor, a, side="right")) - 1
                if lo <= hi:  # else of another text of this id
                    yield doc, th, words, n, int(signed(g[a : a + 1])[0]), lo, hi
            elif a + window <= len(words):
                if n not in longer:
                    longer[n] = signed(grams(h, n, seed=2))
                yield doc, th, words, n, int(longer[n][a]), a, a


@tidy
def longer_batches(batches: Iterable[pa.RecordBatch], window: int, prefix: int, n: int) -> Iterator[pa.RecordBatch]:
    """Rows as those of anchor_batches, a window each, of places whose groups were too large: keyed by n words."""
    for batch in batches:
        rows: list[tuple[int, int, int, int, int]] = []
        of, keys = None, np.zeros(0, dtype=np.int64)
        for doc, th, words, _, _, lo, hi in _windows(batch, window, prefix):
            if of is not words:
                of, keys = words, signed(grams(word_hashes(words), n, seed=2))
            rows += [(int(keys[s]), doc, _part(doc, th), s, -1) for s in range(lo, hi + 1)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["g", "doc", "th", "a", "b"])


@tidy
def suffix_batches(batches: Iterable[pa.RecordBatch], window: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Of the places found, the words of the windows that start there: key, doc, th, lo, words."""
    for batch in batches:
        rows = [(key, doc, th, lo, b" ".join(words[lo : hi + window])) for doc, th, words, _, key, lo, hi in _windows(batch, window, prefix)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["key", "doc", "th", "lo", "words"])


@tidy
def subtree_batches(batches: Iterable[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Repeats, as (doc, th, a, b), of groups whose rows come sorted by key, doc, th and lo."""
    names = ("key", "doc", "th", "lo")
    open_key, nodes, last = None, [], None  # of a group in pieces: one window a node; the last row
    for t, large in pieces(batches, "key", most):
        place = np.stack([t.column(c).to_numpy() for c in names], axis=1)
        new = np.concatenate([[last is None or bool((place[0] != last).any())], (place[1:] != place[:-1]).any(axis=1)])
        last = place[-1]
        place = place[new]  # a document may be in the table more than once
        text = t.column("words").combine_chunks().cast(pa.large_binary()).filter(pa.array(new))
        if not len(place):
            continue
        if not large or place[0, 0] != open_key:
            open_key, nodes = (place[0, 0] if large else None), []
        known = len(nodes)
        rows = pa.concat_arrays([pa.array(nodes, pa.large_binary()), text]) if known else text
        group = np.cumsum(np.concatenate([[0], np.diff(place[:, 0]) != 0]))
        tree = Subtree(rows, np.concatenate([np.zeros(known, dtype=np.int64), group]), window)
        ends = np.append(tree.start, len(tree.repeat))[known:]
        first = ends[0]
        edge = np.zeros(len(tree.repeat) - first + 1, dtype=np.int8)
        edge[:-1] = tree.repeat[first:]
        a, b = (np.array(x, dtype=np.int64) for x in zip(*_ranges(edge > 0), strict=True)) if edge.any() else (np.zeros(0, dtype=np.int64),) * 2
        row = np.searchsorted(ends - first, a, side="right") - 1
        shift = place[row, 3] - (ends[row] - first)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place[row, 1], place[row, 2], a + shift, b + shift)], names=["doc", "th", "a", "b"])
        if large:
            whole = np.zeros(len(tree.repeat), dtype=bool)
            whole[tree.leaves] = True
            words = rows.to_pylist()
            for p in np.flatnonzero(whole & ~tree.repeat):
                if p >= first:
                    r = int(np.searchsorted(tree.start, p, side="right")) - 1
                    k = int(p - tree.start[r])
                    nodes.append(b" ".join(words[r].split(b" ")[k : k + window]))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with doc, part, th: the id, which of its texts this is, and a hash of the text."""
    doc, th = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64(F.col("text").cast("string"))
    part = F.when(F.col("doc_id").isNull(), th).otherwise(F.pmod(th, F.lit(PARTS)))
    return docs.select("*", doc.alias("doc"), part.alias("part"), th.alias("th"))


def _listed(rows: DataFrame, n: int, *what: str) -> DataFrame:
    """What is said of each document's texts in one row, dealt as the texts are."""
    dealt = rows.repartition(n, "doc", "part")
    return dealt.groupBy(F.col("doc").alias("__doc"), F.col("part").alias("__part")).agg(F.collect_list(F.struct(*what)).alias("found"))


def _joined(texts: DataFrame, said: DataFrame, how: str) -> DataFrame:
    same = (F.col("doc") == F.col("__doc")) & (F.col("part") == F.col("__part"))
    return texts.join(said.hint("merge"), same, how).drop("__doc", "__part")


def held_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, text, doc, part, th as they come; the same in a table bucketed by doc and part; the number
    of buckets. Texts are moved once, and what is said of them is moved to them."""
    slim = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    n = buckets(docs.sparkSession)
    return slim, bucketed(slim.repartition(n, "doc", "part"), n, "doc", "part"), n


def repeats(slim: DataFrame, texts: DataFrame, n: int, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP, most: int = SUBTREE) -> DataFrame:
    """Spans of window starts (doc, part, th, a to b) whose windows start earlier elsewhere, of held_texts()."""

    def counted(places: DataFrame) -> DataFrame:
        dealt = places.repartition(F.col("g")).sortWithinPartitions("g")
        return written(dealt.mapInArrow(lambda b: prefix_batches(b, group), "doc long, th long, a long, b long"))

    def with_places(places: DataFrame) -> DataFrame:
        mine = _listed(places.withColumnRenamed("th", "part"), n, "a", "n")
        return _joined(texts.select("doc", "part", "th", "text"), mine, "inner").select("doc", "th", "text", "found")

    anchors = slim.select("doc", "th", "text").mapInArrow(lambda b: anchor_batches(b, window, prefix), "g long, doc long, th long, a long, b long")
    found = counted(anchors)
    ready, level, at = found.where("b = -1").withColumn("n", F.lit(prefix)), found, prefix
    for longer in (*(x for x in LONGER if prefix < x < window), window):
        large = level.where("b = -2").withColumn("n", F.lit(at))
        if large.isEmpty():
            break
        level = counted(with_places(large).mapInArrow(lambda b, k=longer: longer_batches(b, window, prefix, k), "g long, doc long, th long, a long, b long"))
        ready, at = ready.unionByName(level.where("b = -1" if longer < window else "b < 0").withColumn("n", F.lit(longer))), longer
    suffixes = with_places(ready).mapInArrow(lambda b: suffix_batches(b, window, prefix), "key long, doc long, th long, lo long, words binary")
    dealt = suffixes.repartition(F.col("key")).sortWithinPartitions("key", "doc", "th", "lo")
    later = written(dealt.mapInArrow(lambda b: subtree_batches(b, window, most), "doc long, th long, a long, b long"))
    spans = found.where("b >= 0").unionByName(later)
    return spans.withColumn("part", F.when(F.col("doc") == LAST, F.col("th")).otherwise(F.pmod("th", F.lit(PARTS))))


def _covered(n: int, spans, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    for e in spans or ():
        edge[e["a"]] += 1
        edge[e["b"] + window] -= 1
    return np.cumsum(edge)[:n] > 0


def _own(th: int, found) -> list[dict]:
    return [e for e in found or () if e["th"] == th]


def digests(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest = [], [], []
            for text, th, found in zip(*(batch.column(c) for c in ("text", "th")), batch.column("found").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                if spans := _own(th.as_py(), found):
                    covered = _covered(len(words), spans, window)
                    gone.append(int(covered.sum()))
                    n.append(len(words))
                    words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                else:
                    gone.append(0)
                    n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim, texts, n = held_texts(docs)
    said = _listed(repeats(slim, texts, n, window, **options), n, "th", "a", "b")
    return _joined(texts, said, "left").select("doc_id", "text", "th", "found").mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduped(docs: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """The same rows and columns without the repeats."""
    ship(docs.sparkSession)
    slim, texts, n = held_texts(docs)
    said = _listed(repeats(slim, texts, n, window, **options), n, "th", "a", "b").withColumnRenamed("found", "__found")
    docs, back = masked(docs, "doc_id", "text")
    schema = docs.schema
    keys = _keyed(docs).withColumnsRenamed({"th": "__th"})

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("doc", "part", "__th", "__found")]
            arrays = [batch.column(c) for c in names]
            k, out = names.index("text"), []
            for text, th, found in zip(*(batch.column(c).to_pylist() for c in ("text", "__th", "__found")), strict=True):
                if spans := _own(th, found):
                    words = text.encode().split()
                    text = b" ".join(w for w, c in zip(words, _covered(len(words), spans, window).tolist(), strict=True) if not c).decode()
                out.append(text)
            arrays[k] = pa.array(out, arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return back(_joined(keys, said, "left").mapInArrow(rows, schema))
