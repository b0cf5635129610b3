"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashes of word shingles in one global order: rare ones first, then those of the
frequent class, each by hash. A document with n tokens that must share at least a of them
with a partner has a prefix of n - a + 1 tokens, and one of n - a + 2 in which partners share
two. So it suffices to index single rare tokens of the first and combinations of two frequent
tokens of the second. Documents over LONG tokens, whose combinations would outgrow their
texts, index their frequent tokens alone (around LONG both ways, so that no pair falls between).
Their prefixes go on for one token in SPARE, so partners share that many tokens more, and a document
that meets others on fewer keys has no partner: most that share a phrase by chance go so, before any text moves.

Which tokens are frequent is counted over all documents: each batch reports the tokens in
more than one of FREQUENT of its documents. The class only steers the cost. It holds at most
MAX_FREQUENT tokens, so it can be broadcast.

1. Buckets. The index is dealt out by key as pairs of key and set; what only one set has goes at
   once. The others' rows carry the size of the set and 32 counts of its tokens by hash;
   sizes and counts exclude pairs that cannot reach the threshold. What leaves a bucket is not
   pairs but its rows that have some partner left, each once, so a bucket gives no more rows
   than it holds, and of a large group each row stops at its first partner. Copies of a set
   are one row.
2. First round. Each of those documents goes, with its text, to one of its buckets, the one
   of least key, as near copies mostly agree on it. There the sets are verified, and what
   leaves is a spanning forest of the links; connected components name the documents.
3. Second round. Buckets whose documents have different names are gone through again, with
   finer counts; rows with a partner of another name, that no first round compared them with, get
   their tokens, are verified, and again only a forest leaves. Buckets with at most FEW such rows give
   their pairs instead, each of which is then looked at once; only rows of larger ones carry their lesser
   keys, for that. So no link between components is lost, and nothing lists the pairs within a large group.

A bucket of over BLOCK rows is cut into blocks by a hash of the set. A row that finds no
partner in its own block is shown to all others; of a large group hardly any is. Sets are
compared by 64-bit hashes of their shingles.

Defined results: an empty set (null text, no words) links with nothing. Fewer words than a
shingle form one shingle. A null doc_id links with nothing and has a null component. Rows
with equal doc_id are one node that has the links of all of them. Repeated rows stay rows.
An empty table gives an empty table. join() returns only its own columns; keep_one() those of
its input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, buckets, masked, release, ship, sliced, tables, tidy, written
from .components import components
from .hashing import U, by_key, mix, shingles, signed

FREQUENT = 512
MAX_FREQUENT = 1 << 18
LONG = 128
SPARE = 32
FEW = 16
BLOCK = 4096
TOKENS = 1 << 21  # tokens of the sets that are verified together
BINS = 32
SKETCH = 256
SAMPLE = 2000  # texts for the dictionary that compresses them
ROWS = 2500  # documents whose sets are held at once
GOLD = 0x9E3779B97F4A7C15


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _counts(tokens: np.ndarray, bins: int) -> np.ndarray:
    """Tokens by the low bits of their hash, counted modulo 16."""
    return (np.bincount((tokens & U(bins - 1)).astype(np.int64), minlength=bins) & 15).astype(np.uint8)


def _signature(tokens: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The counts, two in a byte."""
    c = _counts(tokens, bins)
    return c[::2] | c[1::2] << 4


def _unpacked(sign: np.ndarray) -> np.ndarray:
    return np.stack([sign & 15, sign >> 4], axis=2).reshape(len(sign), -1)


AROUND = np.minimum(np.arange(16), 16 - np.arange(16)).astype(np.uint8)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far counts differ in sum, each the shorter way round; two sets differ by no fewer tokens."""
    return AROUND[(a - b) & 15].sum(axis=1, dtype=np.int64)


def _short(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _first(batch: pa.RecordBatch, sets: list[np.ndarray], digests: list[bytes | None]) -> list[int]:
    """Of each set of two or more tokens (one alone has only equal partners), the row of least doc_id."""
    least: dict[bytes, tuple[int, int]] = {}
    for i, (doc, d) in enumerate(zip(batch.column("doc_id").to_pylist(), digests, strict=True)):
        if doc is not None and len(sets[i]) > 1 and (d not in least or doc < least[d][0]):
            least[d] = (doc, i)
    return sorted(i for _, i in least.values())


def _sets(batch: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    sets = [shingles(x.as_py(), k) for x in batch.column("text")]
    return sets, [_digest(s) if len(s) else None for s in sets]


NODES = "doc_id long, n long, digest binary, short long, token long, times long, sketch binary, s0 long, s1 long"


@tidy
def node_batches(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row a document, and rows (token, times) of what is frequent in the slice."""
    for batch in sliced(batches, ROWS):
        sets, digests = _sets(batch, k)
        rows = _first(batch, sets, digests)
        token, times = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        if rows:
            token, times = np.unique(np.concatenate([sets[i] for i in rows]), return_counts=True)
            often = times >= max(2, len(rows) // FREQUENT)
            token, times = token[often], times[often]
        n, m = len(sets), len(token)
        signs = np.stack([_signature(s).view(np.int64) for s in sets]) if n else np.zeros((0, 2), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, pa.int64())]),
                pa.array([*map(len, sets), *[None] * m], pa.int64()),
                pa.array([*digests, *[None] * m], pa.binary()),
                pa.array([*(_short(d) if d else None for d in digests), *[None] * m], pa.int64()),
                pa.array([None] * n + signed(token).tolist(), pa.int64()),
                pa.array([None] * n + times.tolist(), pa.int64()),
                pa.array([*(_signature(s, SKETCH).tobytes() if len(s) > 1 else None for s in sets), *[None] * m], pa.binary()),
                *(pa.array([*signs[:, c].tolist(), *[None] * m], pa.int64()) for c in (0, 1)),
            ],
            names=[c.split()[0] for c in NODES.split(", ")],
        )


def common_parts(texts: DataFrame) -> bytes:
    """A dictionary for compressing texts, from the beginnings of at most SAMPLE of them; empty where they are too few.
    It says nothing of results, only of the bytes that move."""
    rows = texts.where("length(text) > 64").select(F.substring("text", 1, 4096).alias("text")).limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(1 << 16, [r["text"].encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


@tidy
def pack_batches(batches: Iterable[pa.RecordBatch], common: bytes) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they move."""
    packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(common) if common else None)
    for batch in batches:
        packed = [packer.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc", "text"])


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n must share with a partner at least."""
    return -(-percent * n // 100)


def enough(found: DataFrame, percent: int) -> DataFrame:
    """Those rows of the index that a partner was found for whose set has so many of them as it must share with a
    partner. A partner of n tokens has needed(n) at least; where that is over LONG, both have prefixes of single
    tokens, as far on as SPARE says for the lesser one."""
    a = F.ceil(F.col("n") * percent / 100)
    least = F.when(a > LONG, 1 + F.floor(a / SPARE)).otherwise(1)
    met = found.groupBy("digest", "n").agg(F.count_distinct("key").alias("met")).where(F.col("met") >= least)
    return found.join(met.select("digest"), "digest", "left_semi")


ENTRY = "key long, base long, blocks int, digest long"
INDEX = "key long, base long, blocks int, doc long, digest long, n long, s0 long, s1 long"


def _in_block(base: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The key of a bucket's block."""
    return mix(base + (own.astype(U) + U(1)) * U(GOLD))


@tidy
def index_batches(batches: Iterable[pa.RecordBatch], k: int, percent: int, long: int, frequent: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of the index, see ENTRY; base is the key of a bucket that is cut into blocks, else null.
    frequent is sorted; shares: blocks of each."""
    for batch in sliced(batches, ROWS):
        keys, blocks, held = [], [], []
        sets, digests = _sets(batch, k)
        rows = _first(batch, sets, digests)
        for i in rows:
            s = sets[i]
            n = len(s)
            p = n - needed(n, percent) + 1 + (n // SPARE if n > long else 0)
            at = np.searchsorted(frequent, s)
            often = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == s) if len(frequent) else np.zeros(n, dtype=bool)
            rare = s[~often][:p]
            own, cut = [rare], [np.ones(len(rare), dtype=np.int64)]
            if len(rare) < p + 1:
                rest, b = s[often][: p + 1 - len(rare)], shares[at[often][: p + 1 - len(rare)]]
                if n <= long and len(rest) > 1:
                    x, y = np.triu_indices(len(rest), 1)
                    own.append(mix(rest[x] * U(3) + rest[y]))
                    cut.append(np.minimum(b[x], b[y]))
                if 100 * n > percent * long:
                    own.append(mix(rest ^ U(0x5851F42D4C957F2D)))
                    cut.append(b)
            keys.append(np.concatenate(own))
            blocks.append(np.concatenate(cut))
            held.append(len(keys[-1]))
        if not keys:
            continue
        base, b = np.concatenate(keys), np.concatenate(blocks)
        digest = np.repeat(np.array([_short(digests[i]) for i in rows], dtype=np.int64), held)
        hot = b > 1
        key = np.where(hot, _in_block(base, mix(digest.view(U)) % b.astype(U)), base)
        yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(base), mask=~hot), pa.array(b.astype(np.int32)), pa.array(digest)], names=[f.split()[0] for f in ENTRY.split(", ")])


@tidy
def met_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of the index, sorted by key and digest, each set once: those of keys that two sets have, and all of
    buckets in blocks. Most keys are one set's alone, and their rows carry nothing else through the shuffle."""
    for t in by_key(batches, "key"):
        t = t.combine_chunks()
        key, digest = t.column("key").to_numpy(), t.column("digest").to_numpy()
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])])
        t, key = t.filter(pa.array(~again)).combine_chunks(), key[~again]
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        keep = ~(new[:-1] & new[1:]) | t.column("base").is_valid().to_numpy(zero_copy_only=False) if len(key) else new[:0]
        for batch in t.filter(pa.array(keep)).to_batches():
            yield batch


def partnered(key: np.ndarray, n: np.ndarray, sign: np.ndarray, name: np.ndarray, room: np.ndarray, guest: np.ndarray, percent: int, fit: Callable | None = None) -> np.ndarray:
    """Which rows have a partner in their bucket: of another name and room, and sizes and counts that may
    reach the threshold; where there are guests, one of a pair must be a guest and one not; and fit, if
    given, must say yes to the pair. Rows come sorted by key and n. A pair is looked at as long as one of
    its rows has no partner."""
    found = np.zeros(len(key), dtype=bool)
    bucket = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
    guests = guest.any()
    i, step, piece = np.arange(1, len(key)), 1, (1 << 20) // sign.shape[1]
    while len(i := i[i >= step]):
        j = i - step
        ok = (bucket[i] == bucket[j]) & (100 * n[j] >= percent * n[i])  # once false, also for every larger step
        i, j = i[ok], j[ok]
        look = ~(found[i] & found[j]) & (name[i] != name[j]) & (room[i] != room[j])
        if guests:
            look &= guest[i] != guest[j]
        x, y = i[look], j[look]
        for c in range(0, len(x), piece):
            a, b = x[c : c + piece], y[c : c + piece]
            gap = _gap(sign[a], sign[b])
            # |x^y| <= (|x|+|y|) (1-t)/(1+t)
            close = gap * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
            a, b = a[close], b[close]
            if fit is not None and len(a):
                yes = fit(a, b)
                a, b = a[yes], b[yes]
            found[a] = True
            found[b] = True
        if step & (step - 1) == 0 and len(i):  # a row with a partner goes on only for rows further back that have none
            bare, first = np.flatnonzero(~found), np.full(bucket[-1] + 1, len(key))
            np.minimum.at(first, bucket[bare], bare)
            i = i[~found[i] | (first[bucket[i]] <= i - step)]
        step += 1
    return found


PASSED = INDEX + ", name long, room long, asks boolean, guest boolean, partner boolean"
COLUMNS = [f.split()[0] for f in PASSED.split(", ")]


@tidy
def bucket_batches(batches: Iterable[pa.RecordBatch], percent: int, block: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Rows, see PASSED, that have a partner; of buckets in blocks also the others. With cut, buckets of
    over block rows come out in blocks, with a null partner, not looked through. Rows come sorted by key,
    n, digest and doc; of each set the first counts."""
    for t in by_key(batches, "key"):
        t = t.combine_chunks()
        key, n, digest = (t.column(c).to_numpy() for c in ("key", "n", "digest"))
        guest = t.column("guest").to_numpy(zero_copy_only=False)
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]) & (guest[1:] == guest[:-1])])
        if again.any():
            t = t.filter(pa.array(~again)).combine_chunks()
            key, n, digest, guest = key[~again], n[~again], digest[~again], guest[~again]
        whole = t.column("base").is_null().to_numpy(zero_copy_only=False)
        _, which, rows = np.unique(key, return_inverse=True, return_counts=True)
        large = (rows[which] > block) & whole & cut
        if large.any():
            b = -(-rows[which][large] // block)
            cols = {c: t.column(c).filter(pa.array(large)).combine_chunks() for c in COLUMNS}
            cols |= {"key": pa.array(signed(_in_block(key[large].view(U), mix(digest[large].view(U)) % b.astype(U)))), "base": pa.array(key[large]), "blocks": pa.array(b.astype(np.int32)), "partner": pa.nulls(len(b), pa.bool_())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in COLUMNS], names=COLUMNS)
            t = t.filter(pa.array(~large)).combine_chunks()
            key, n, guest, whole = key[~large], n[~large], guest[~large], whole[~large]
        if not len(key):
            continue
        sign = _unpacked(np.stack([t.column("s0").to_numpy(), t.column("s1").to_numpy()], axis=1).view(np.uint8))
        found = partnered(key, n, sign, t.column("name").to_numpy(), t.column("room").to_numpy(), guest, percent)
        had = t.column("partner").fill_null(False).to_numpy(zero_copy_only=False)
        keep = found & ~had if guest.any() else found | ~whole
        if keep.any():
            cols = {c: t.column(c).filter(pa.array(keep)).combine_chunks() for c in COLUMNS} | {"partner": pa.array(found[keep])}
            yield pa.RecordBatch.from_arrays([cols[c] for c in COLUMNS], names=COLUMNS)


@tidy
def guest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets in blocks, as guests in all the other blocks."""
    for batch in batches:
        for piece in sliced([batch], 256):
            if not piece.num_rows:
                continue
            b = piece.column("blocks").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(b)), b)
            to = np.arange(b.sum()) - np.repeat(np.cumsum(b) - b, b)
            own = (mix(piece.column("digest").to_numpy().view(U)) % b.astype(U)).astype(np.int64)
            row, to = row[to != own[row]], to[to != own[row]]
            t = piece.take(pa.array(row))
            cols = {c: t.column(c) for c in COLUMNS}
            cols |= {"key": pa.array(signed(_in_block(t.column("base").to_numpy().view(U), to))), "guest": pa.array(np.ones(len(row), dtype=bool))}
            yield pa.RecordBatch.from_arrays([cols[c] for c in COLUMNS], names=COLUMNS)


def with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """key (of the whole bucket), doc, digest, n, s0, s1, name, room of the rows, see PASSED, that have a
    partner. Rows of the index, see INDEX, are sets of their own."""
    block = BLOCK

    def passed(df: DataFrame, cut: bool) -> DataFrame:
        dealt = df.repartition(F.col("key")).sortWithinPartitions("key", "n", "digest", *[c for c in ("guest", "doc") if c in df.columns])
        missing = {"name": F.col("digest"), "room": F.col("digest"), "asks": F.lit(True), "guest": F.lit(False), "partner": F.lit(False)}
        dealt = dealt.withColumns({c: x for c, x in missing.items() if c not in df.columns})
        return written(dealt.mapInArrow(lambda b: bucket_batches(b, percent, block, cut), PASSED))

    seen = passed(rows, True)
    late = seen.where("partner IS NULL")
    if not late.isEmpty():
        seen = seen.where("partner IS NOT NULL").unionByName(passed(late, False))
    found = seen.where("partner")
    bare = seen.where("NOT partner AND asks")
    if not bare.isEmpty():
        bases = bare.select("base").distinct()
        there = seen.where("base IS NOT NULL").join(bases, "base", "left_semi").select(*COLUMNS)
        met = passed(there.unionByName(bare.mapInArrow(guest_batches, PASSED)), False)
        found = found.unionByName(met.where("partner"))
    out = found.select(F.coalesce("base", "key").alias("key"), "doc", "digest", "n", "s0", "s1", "name", "room")
    return out if bare.isEmpty() else out.distinct()


def forest(doc: np.ndarray, n: np.ndarray, sets: list[np.ndarray], name: np.ndarray, room: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what can be joined of rows, sorted by n, of different names and rooms: of rows that
    are joined already, no further link."""
    sign = np.stack([_counts(s, SKETCH) for s in sets])
    name = np.unique(name, return_inverse=True)[1]
    last = np.searchsorted(percent * n, 100 * n, side="right")
    out = []
    for p in range(len(doc)):
        c = np.arange(p + 1, last[p])
        c = c[(name[c] != name[p]) & (room[c] != room[p])]
        if len(c):
            gap = _gap(sign[c], sign[p])
            c = c[gap * (100 + percent) <= (n[c] + n[p]) * (100 - percent)]
        if not len(c):
            continue
        every, own = np.concatenate([sets[x] for x in c]), sets[p]
        both = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        shared = np.add.reduceat(both, np.cumsum(n[c]) - n[c], dtype=np.int64)
        c = c[100 * shared >= percent * (n[p] + n[c] - shared)]
        joined, first = np.unique(name[c], return_index=True)
        out += [(int(doc[p]), int(x)) for x in doc[c[first]] if x != doc[p]]
        name[np.isin(name, joined)] = name[p]
    return out


@tidy
def forest_batches(batches: Iterable[pa.RecordBatch], k: int, percent: int, common: bytes) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (place, doc, digest, n, name, room, text) sorted by place and n. Of a doc_id with
    several texts, the one of the digest counts."""
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(common) if common else None)
    for t in by_key(batches, "place"):
        place = t.column("place").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                part = t.slice(a, b - a)
                sets = [shingles(unpacker.decompress(x.as_py()).decode(), k) for x in part.column("text")]
                doc, digest, n, name, room = (part.column(c).to_numpy() for c in ("doc", "digest", "n", "name", "room"))
                own = np.flatnonzero([len(s) == m and _short(_digest(s)) == d for s, m, d in zip(sets, n.tolist(), digest.tolist(), strict=True)])
                out += forest(doc[own], n[own], [sets[i] for i in own], name[own], room[own], percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _verified(rows: DataFrame, texts: DataFrame, k: int, percent: int, common: bytes) -> DataFrame:
    """Links among rows (place, doc, digest, n, name, room)."""
    dealt = rows.join(texts, "doc").select("place", "doc", "digest", "n", "name", "room", "text").repartition(F.col("place")).sortWithinPartitions("place", "n")
    return dealt.mapInArrow(lambda b: forest_batches(b, k, percent, common), "a long, b long")


SHOWN = ["place", "key", "doc", "digest", "n", "name", "room", "sketch", "keys"]


def shared_before(key: np.ndarray, keys: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of pairs of rows: whether the least of the keys that both have is that of their bucket."""
    keys = [x[x < k] for x, k in zip(keys, key.tolist(), strict=True)]
    size = np.array([len(x) for x in keys], dtype=np.int64)
    start = np.cumsum(size) - size
    kinds, rank = np.unique(np.concatenate(keys), return_inverse=True)
    held = np.sort(np.repeat(np.arange(len(keys)), size) * len(kinds) + rank) if len(kinds) else np.zeros(0, dtype=np.int64)

    def fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = size[a]
        if not n.any():
            return np.ones(len(a), dtype=bool)
        pair = np.repeat(np.arange(len(a)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[a], n)
        code = b[pair] * len(kinds) + rank[at]
        hit = held[np.minimum(np.searchsorted(held, code), len(held) - 1)] == code
        return np.bincount(pair, weights=hit, minlength=len(a)) == 0

    return fit


@tidy
def nearer_batches(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows, see SHOWN, sorted by place and n, those with a partner that finer counts leave possible and
    that they share no lesser key with; so a pair meets in one bucket."""
    names = [c for c in SHOWN if c not in ("key", "sketch", "keys")]
    for t in by_key(batches, "place"):
        t = t.combine_chunks()
        place, key, n, name, room = (t.column(c).to_numpy() for c in ("place", "key", "n", "name", "room"))
        sign = _unpacked(np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(t), -1))
        lists = t.column("keys").combine_chunks()
        fit = shared_before(key, np.split(lists.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(lists).to_numpy())[:-1]))
        keep = pa.array(partnered(place, n, sign, name, room, np.zeros(len(t), dtype=bool), percent, fit))
        yield pa.RecordBatch.from_arrays([t.column(c).filter(keep).combine_chunks() for c in names], names=names)


def _parts(count: str, tokens: str) -> F.Column:
    return F.greatest(F.ceil(F.col(count) / F.lit(BLOCK)), F.ceil(F.col(tokens) / F.lit(TOKENS))).cast("int")


def _first_round(found: DataFrame, texts: DataFrame, k: int, percent: int, common: bytes) -> tuple[DataFrame, DataFrame]:
    """Links within the bucket of least key of each document, and where (room) each document was verified."""
    home = found.groupBy("doc", "digest", "n").agg(F.min("key").alias("home"))
    size = home.groupBy("home").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"), F.min(F.struct("digest", "doc")).alias("pivot")).where("rows > 1")
    size = size.select("home", _parts("rows", "tokens").alias("parts"), "pivot")
    placed = home.join(size, "home").withColumn("own", F.pmod(F.xxhash64("digest"), "parts").cast("int"))
    # Of a home in parts, one document is shown to all.
    pivot = (F.col("pivot.digest") == F.col("digest")) & (F.col("pivot.doc") == F.col("doc"))
    to = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own")))
    placed = placed.withColumn("to", to)
    rooms = placed.where("to = own").select("doc", "digest", F.xxhash64("home", "own").alias("room"))
    rows = placed.select(F.xxhash64("home", "to").alias("place"), "doc", "digest", "n", F.col("digest").alias("name"), F.col("digest").alias("room"))
    return _verified(rows, texts, k, percent, common), rooms


@tidy
def close_batches(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sketches those whose finer counts leave a link possible, without the sketches."""
    for batch in sliced(batches, ROWS):
        names = [c for c in batch.schema.names if not c.endswith("_sketch")]
        a, b = (_unpacked(np.frombuffer(b"".join(batch.column(f"{s}_sketch").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, SKETCH), dtype=np.uint8) for s in "ab")
        size = batch.column("a_n").to_numpy() + batch.column("b_n").to_numpy()
        yield batch.select(names).filter(pa.array(_gap(a, b) * (100 + percent) <= size * (100 - percent)))


def _close_pairs(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """place, doc, digest, n, name, room of pairs of rows of a key, of different names and rooms, that finer counts leave
    possible: each pair once, those of one row in places of some FEW."""
    own = ("doc", "digest", "n", "name", "room")
    a, b = (rows.select("key", *[F.col(c).alias(f"{s}_{c}") for c in own]) for s in "ab")
    near = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (F.col("a_name") != F.col("b_name")) & (F.col("a_room") != F.col("b_room"))
    pairs = a.join(b, "key").where((F.col("a_digest") < F.col("b_digest")) & near).drop("key").distinct()
    for s in "ab":
        pairs = pairs.join(sketches.select(*[F.col(c).alias(f"{s}_{c}") for c in ("doc", "digest", "sketch")]), [f"{s}_doc", f"{s}_digest"])
    names = [f"{s}_{c}" for s in "ab" for c in own]
    pairs = pairs.select(*names, "a_sketch", "b_sketch").mapInArrow(lambda x: close_batches(x, percent), ", ".join(f"{c} long" for c in names))
    parts = F.ceil(F.count("*").over(Window.partitionBy("a_digest")) / FEW)
    pairs = pairs.withColumn("place", F.xxhash64("a_digest", F.pmod(F.xxhash64("b_digest"), parts)))
    return written(pairs.select("place", F.explode(F.array(*[F.struct(*[F.col(f"{s}_{c}").alias(c) for c in own]) for s in "ab"])).alias("row")).select("place", "row.*").distinct())


def _second_round(found: DataFrame, named: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, percent: int, common: bytes) -> DataFrame:
    """Links between documents of different names in buckets that hold such."""
    rows = found.drop("name", "room").join(named, ["doc", "digest"])
    names = rows.groupBy("key", "name").agg(F.count("*").alias("rows"))
    mixed = names.groupBy("key").agg(F.count("*").alias("names"), F.max_by("name", "rows").alias("major")).where("names > 1").drop("names")
    rows = rows.join(mixed, "key").withColumn("asks", F.col("name") != F.col("major"))
    rows = rows.withColumns({"base": F.lit(None).cast("long"), "blocks": F.lit(1), "guest": F.lit(False), "partner": F.lit(False)}).select(*COLUMNS)
    left = with_partners(rows, percent).drop("s0", "s1")
    sizes = left.groupBy("key").agg(F.count("*").alias("rows"))
    left = written(left.join(sizes, "key"))
    links = _verified(_close_pairs(left.where(F.col("rows") <= FEW), sketches, percent), texts, k, percent, common)
    left = left.where(F.col("rows") > FEW).drop("rows")
    # Of a bucket in parts, rows of its commonest name go to one, the others to all.
    names = left.groupBy("key", "name").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    size = names.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.max_by("name", "rows").alias("major")).select("key", _parts("rows", "tokens").alias("parts"), "major")
    part = F.pmod(F.xxhash64("digest"), "parts").cast("int")
    left = left.join(size, "key").withColumn("to", F.explode(F.when(F.col("name") == F.col("major"), F.array(part)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    keys = left.groupBy("doc", "digest").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # those of one document
    left = left.join(keys.join(sketches, ["doc", "digest"]), ["doc", "digest"]).withColumn("keys", F.filter("keys", lambda k: k < F.col("key")))  # of the others none is asked for
    left = left.select(F.xxhash64("key", "to").alias("place"), *SHOWN[1:])
    dealt = left.repartition(F.col("place")).sortWithinPartitions("place", "n")
    shown = "place long, doc long, digest long, n long, name long, room long"
    return links.unionByName(_verified(written(dealt.mapInArrow(lambda b: nearer_batches(b, percent), shown)), texts, k, percent, common))


def frequent_class(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent tokens, sorted, and the number of blocks of each; at most MAX_FREQUENT."""
    total = rows.where("token IS NULL").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    least = max(2, total["docs"] // FREQUENT, -(-total["tokens"] // MAX_FREQUENT))
    often = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= least).collect()
    token = np.array([r["token"] for r in often], dtype=np.int64).view(U)
    blocks = np.array([-(-r["times"] // BLOCK) for r in often], dtype=np.int64)
    order = np.argsort(token)
    return token[order], blocks[order]


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text). Two documents link when
    100 * |intersection| >= percent * |union|."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = written(texts.mapInArrow(lambda b: node_batches(b, k), NODES))
    shared = spark.sparkContext.broadcast(frequent_class(every))  # at most MAX_FREQUENT tokens
    nodes = every.where("token IS NULL").select("doc_id", "n", "digest")

    long = LONG
    index = texts.mapInArrow(lambda b: index_batches(b, k, percent, long, *shared.value), ENTRY)
    index = index.repartition(F.col("key")).sortWithinPartitions("key", "digest").mapInArrow(met_batches, ENTRY)
    sets = every.where("sketch IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("short").alias("digest")).agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n", "s0", "s1")])
    before = tables()
    found = with_partners(index.join(sets, "digest").select(*[c.split()[0] for c in INDEX.split(", ")]), percent)
    passed = tables() - before
    found = written(enough(found, percent))
    release(passed)
    common = common_parts(texts)
    # Texts move once; what follows reads those of documents that have a partner, by document.
    held = texts.where("doc_id IS NOT NULL").mapInArrow(lambda b: pack_batches(b, common), "doc long, text binary")
    held = bucketed(held.join(found.select("doc").distinct(), "doc", "left_semi"), buckets(spark), "doc")
    links, rooms = _first_round(found, held, k, percent, common)
    links = written(links)
    label = components(links)
    named = found.select("doc", "digest").distinct().join(rooms, ["doc", "digest"], "left").join(label, F.col("doc") == label["node"], "left")
    named = written(named.select("doc", "digest", F.coalesce("component", "doc").alias("name"), F.coalesce("room", "digest").alias("room")))
    sketches = every.where("sketch IS NOT NULL").select(F.col("doc_id").alias("doc"), F.col("short").alias("digest"), "sketch")
    sketches = sketches.join(named.select("doc", "digest"), ["doc", "digest"], "left_semi").dropDuplicates(["doc", "digest"])
    more = written(_second_round(found, named, sketches, held, k, percent, common))
    # Equal sets meet at the least id of their digest.
    least = nodes.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    equal = nodes.where("doc_id IS NOT NULL").join(least, "digest").where("least <> doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    label = written(components(links.unionByName(more).unionByName(equal)))
    out = nodes.join(label, nodes["doc_id"] == label["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of least doc_id, with the columns it came with. Rows
    repeated under that id are that document and stay; so do rows without an id."""
    gone = join(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    plain, back = masked(docs, "doc_id")
    return back(plain.join(gone, plain["doc_id"].cast("long") == gone["__gone"], "left_anti"))
