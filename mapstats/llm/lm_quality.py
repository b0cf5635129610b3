"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

N-grams are runs of ORDER code points as they stand in the text, without classes and without a
fixed code space, so what is counted grows with the trusted text. The model of a language is
trained on all documents whose label says that their quality is good, but for one in HOLD_OUT
by a hash of doc_id; perplexities of those held out give the language's quantile, with which
each document is compared. Texts of fewer than SHORT characters, whose perplexity scatters
more, have quantiles of their own. Where nothing is held out, all trusted documents give it.

1. Texts are packed into slices of bounded size, a row each, in a table bucketed by slice, so
   that they meet what is said of their slice without being moved.
2. Each slice gives its distinct n-grams, with their number in training documents, dealt into
   shards by hash. Shards add them up: a row for each n-gram, of the model and of all texts.
3. Counts, sums and kinds of contexts, counts of counts and the next lower order meet in joins,
   order by order. The n-grams of all texts are joined to the probabilities the same way: those
   not found go on to the next lower order with the weight that their context leaves.
4. The logarithms go back through the shards to the slices that asked, and each slice adds them
   up by document. Nothing that grows with the corpus is broadcast or sent to the driver.

N-grams are told apart inside shards and slices by 64-bit hashes, in the model by themselves.

Defined results: a null or empty text has a null perplexity and is not kept. A language that
is null or not in LANGUAGES is scored by the model of all such documents; where that has no
trusted text, every perplexity is 1, and it is kept, as there is no limit. A perplexity equal to
the limit is kept. Rows are scored one by one; a document labelled twice counts twice. A null
doc_id has no label. U+FFFF stands before a text; one inside a text is taken for the same. An
empty table gives an empty table. Other columns, of any name, are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets, ship, tidy, written
from .hashing import U, mix

LANGUAGES = ("de", "en", "es", "fr")
ORDER = 5
QUANTILE = 0.995
HOLD_OUT = 5
SHORT = 64
SLICE = 5 << 22  # characters of a slice, unless one text has more
DOCS = 1 << 14  # documents of a slice
BLOCK = 1 << 20  # characters looked at together
PLACES = (1 << 22) - 1  # over twice BLOCK
KINDS = 1 << 21  # n-grams that are kept apart before they are added up
SHARDS = 64  # at least
LEVEL = 9  # of compression
PAD = "￿"


def _lang(column) -> F.Column:
    """Number of the language; that of all others is the last."""
    out = F.lit(len(LANGUAGES))
    for i, name in enumerate(LANGUAGES):
        out = F.when(column == name, i).otherwise(out)
    return out.cast("int")


HELD = "slice long, ids array<long>, langs binary, sizes binary, bytes binary, texts binary"


def _column(name: str, values: list | np.ndarray) -> pa.Array:
    return pa.array(values, {"ids": pa.list_(pa.int64()), "slice": pa.int64()}.get(name, pa.binary()))


def _packed(rows: list[tuple[int | None, int, str]]) -> pa.RecordBatch:
    raw = [t.encode() for _, _, t in rows]
    one = {
        "slice": uuid.uuid4().int >> 65,
        "ids": [i for i, _, _ in rows],
        "langs": bytes(lang for _, lang, _ in rows),
        "sizes": np.array([len(t) for _, _, t in rows], dtype="<i8").tobytes(),
        "bytes": np.array([len(b) for b in raw], dtype="<i8").tobytes(),
        "texts": zstandard.compress(b"".join(raw), LEVEL),
    }
    return pa.RecordBatch.from_arrays([_column(c, [x]) for c, x in one.items()], names=list(one))


@tidy
def pack_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices, see HELD."""
    rows, size = [], 0
    for batch in batches:
        for doc, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            t = text.as_py() or ""
            if rows and (size + len(t) > SLICE or len(rows) >= DOCS):
                yield _packed(rows)
                rows, size = [], 0
            rows.append((doc, lang, t))
            size += len(t)
    if rows:
        yield _packed(rows)


def _texts(row: pa.Table) -> list[str]:
    raw = zstandard.decompress(row.column("texts")[0].as_py())
    ends = np.cumsum(np.frombuffer(row.column("bytes")[0].as_py(), dtype="<i8")).tolist()
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


class Block:
    """Some n-grams of a slice, one that ends at each character of the texts: code points, where an n-gram
    starts for each run of equal ones, their hashes and sizes, and whose they are, run after run."""

    def __init__(self, held: list[tuple[int, str]], langs: np.ndarray):
        doc = np.array([i for i, _ in held], dtype=np.uint32)
        size = np.array([len(p) for _, p in held], dtype=np.int64)
        before = ORDER - 1
        self.cp = np.frombuffer("".join(p for _, p in held).encode("utf-32-le"), dtype="<u4")
        wide = self.cp.astype(U)
        many = len(wide) - before
        h = np.repeat(langs[doc], size)[:many].astype(U)
        for k in range(ORDER):
            h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15) + wide[k : k + many]
        at = np.arange((size - before).sum()) + np.repeat(np.arange(len(doc)) * before, size - before)
        h = mix(h[at])
        # Sorted by the upper bits; runs are cut where any bit differs, so one n-gram may have several.
        order = (np.sort((h & ~U(PLACES)) | np.arange(len(h), dtype=U)) & U(PLACES)).astype(np.int64)
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.h, self.n = h[first], np.diff(np.concatenate([first, [len(h)]]))
        self.at = at[order[first]]
        self.first = first
        self.own = np.repeat(doc.astype(np.uint16 if len(langs) <= 1 << 16 else np.uint32), size - before)[order]


def blocks(texts: list[str], langs: np.ndarray) -> Iterator[Block]:
    before, held, size = ORDER - 1, [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t), BLOCK):
            piece = (PAD * before if a == 0 else t[a - before : a]) + t[a : a + BLOCK]
            held.append((i, piece))
            size += len(piece)
            if size >= BLOCK:
                yield Block(held, langs)
                held, size = [], 0
    if held:
        yield Block(held, langs)


class Grams:
    """Distinct n-grams by hash: language, code points and number."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.least = 0

    def add(self, h: np.ndarray, lang: np.ndarray, cp: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((h, lang, cp, n))
        self.size += len(h)
        if self.size > KINDS + self.least:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All of them, by hash."""
        if len(self.parts) != 1:
            empty = (np.zeros(0, dtype=U), np.zeros(0, dtype=np.uint8), np.zeros((0, ORDER), dtype="<u4"), np.zeros(0, dtype=np.int64))
            h, lang, cp, n = (np.concatenate(x) for x in zip(empty, *self.parts, strict=True))
            order = np.argsort(h)
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]])) if len(h) else order
            total = np.add.reduceat(n[order], first) if len(h) else n
            self.parts = [(h[order[first]], lang[order[first]], cp[order[first]], total)]
            self.size = self.least = len(first)
        return self.parts[0]


def slice_grams(parts: Iterable[Block], langs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of a slice, by hash; each text counts as often as times says."""
    out = Grams()
    for b in parts:
        out.add(b.h, langs[b.own[b.first]], b.cp[b.at[:, None] + np.arange(ORDER)], np.add.reduceat(times[b.own], b.first))
    return out.merged()


def _by_shard(h: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each shard that has some of the hashes, which they are."""
    shard = ((h >> U(20)) % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1], [True]])) if len(h) else np.zeros(1, dtype=np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(shard[order[a]]), order[a:b]


ASKED = "slice long, shard int, hashed long, langs binary, grams binary, times binary"


def ask(held: pa.Table, marks: pa.Table, shards: int) -> pa.Table:
    """The n-grams of a slice, see ASKED."""
    out: dict[str, list] = {c.split()[0]: [] for c in ASKED.split(", ")}
    if len(held):
        langs = np.frombuffer(held.column("langs")[0].as_py(), dtype=np.uint8)
        times = np.zeros(len(langs), dtype=np.int64)
        if len(marks):
            times[marks.column("pos").to_numpy()] = marks.column("times").to_numpy()
        h, lang, cp, n = slice_grams(blocks(_texts(held), langs), langs, times)
        for shard, rows in _by_shard(h, shards):
            out["slice"].append(held.column("slice")[0].as_py())
            out["shard"].append(shard)
            out["hashed"].append(len(rows))
            out["langs"].append(zstandard.compress(lang[rows].tobytes(), LEVEL))
            out["grams"].append(zstandard.compress(cp[rows].T.tobytes(), LEVEL))
            out["times"].append(zstandard.compress(n[rows].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), LEVEL))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds, strict=True)})


def _unpacked(langs: bytes, grams: bytes, times: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lang = np.frombuffer(zstandard.decompress(langs), dtype=np.uint8)
    cp = np.ascontiguousarray(np.frombuffer(zstandard.decompress(grams), dtype="<u4").reshape(ORDER, -1).T)
    n = np.ascontiguousarray(np.frombuffer(zstandard.decompress(times), dtype=np.uint8).reshape(8, -1).T).view("<i8").reshape(-1) if times else np.zeros(len(lang), dtype=np.int64)
    return _hashes(lang, cp), lang, cp, n


def _hashes(lang: np.ndarray, cp: np.ndarray) -> np.ndarray:
    h = lang.astype(U)
    for k in range(ORDER):
        h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15) + cp[:, k]
    return mix(h)


def _strings(cp: np.ndarray) -> list[str]:
    s = cp.tobytes().decode("utf-32-le")
    return [s[i : i + ORDER] for i in range(0, len(s), ORDER)]


@tidy
def add_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, lang, gram, n of rows, see ASKED, sorted by shard."""
    names, own, held = ["shard", "lang", "gram", "n"], None, Grams()

    def out() -> Iterator[pa.RecordBatch]:
        _, lang, cp, n = held.merged()
        for a in range(0, len(lang), 1 << 16):
            b = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lang[b]), own, dtype=np.int32)), pa.array(lang[b].astype(np.int32)), pa.array(_strings(cp[b]), pa.string()), pa.array(n[b])], names=names)

    for batch in batches:
        for shard, langs, grams, times in zip(*(batch.column(c).to_pylist() for c in ("shard", "langs", "grams", "times")), strict=True):
            if shard != own and own is not None:
                yield from out()
                held = Grams()
            own = shard
            held.add(*_unpacked(langs, grams, times))
    if own is not None:
        yield from out()


def probabilities(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: lang, gram, p of the n-grams seen, and lang, context, rest, the weight left
    for the lower order, of their contexts: modified Kneser-Ney, by joins."""
    by_order = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        # How many kinds of character were seen before the n-gram.
        by_order[k] = by_order[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    base = by_order[1].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("lower"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, ORDER + 1):
        grams = by_order[k].withColumn("context", F.substring("gram", 1, k - 1))
        many = [F.sum((F.col("n") == i).cast("double")).alias(f"k{i}") for i in (1, 2, 3, 4)]
        kinds = grams.groupBy("lang").agg(*many).withColumn("k1", F.greatest("k1", F.lit(1.0)))
        y = F.col("k1") / (F.col("k1") + 2 * F.col("k2"))

        def discount(i, y=y):
            d = i - (i + 1) * y * F.col(f"k{i + 1}") / F.nullif(F.col(f"k{i}"), F.lit(0.0))
            return F.greatest(F.lit(0.1), F.least(F.coalesce(d, F.lit(0.5 * i)), F.lit(i - 0.05)))

        limits = F.broadcast(kinds.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)]))  # a row a language
        per = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), *[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2)], F.sum((F.col("n") >= 3).cast("double")).alias("n3"))
        per = per.join(limits, "lang").withColumn("rest", (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total"))
        rests = written(per.select("lang", "context", "total", "rest"))
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = grams.join(limits, "lang").join(rests, ["lang", "context"]).withColumn("own", F.greatest(F.col("n") - taken, F.lit(0.0)) / F.col("total"))
        if k == 1:
            seen = seen.join(F.broadcast(base), "lang")  # a row a language
        else:
            lower = out[-1][0].select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
            seen = seen.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower, ["lang", "tail"])
        out.append((written(seen.select("lang", "gram", (F.col("own") + F.col("rest") * F.col("lower")).alias("p"))), rests.select("lang", "context", "rest")))
    return out


def logarithms(asked: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """asked(lang, gram, ...) with a column log; of a language without a model, 0."""
    names = asked.columns
    left = asked.withColumns({"tail": F.col("gram"), "weight": F.lit(1.0)})
    out = None
    for k in range(ORDER, 0, -1):
        p, rests = model[k - 1]
        met = written(left.join(p.withColumnRenamed("gram", "tail"), ["lang", "tail"], "left"))
        done = met.where("p IS NOT NULL").select(*names, F.log(F.col("weight") * F.col("p")).alias("log"))
        out = done if out is None else out.unionByName(done)
        left = met.where("p IS NULL").withColumn("context", F.substring("tail", 1, k - 1)).join(rests, ["lang", "context"], "left")
        left = left.select(*names, F.substring("tail", 2, k - 1).alias("tail"), (F.col("weight") * F.coalesce("rest", F.lit(1.0))).alias("weight"))
    base = model[0][0].groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("base"))
    left = left.join(F.broadcast(base), "lang", "left")  # a row a language
    return out.unionByName(left.select(*names, F.coalesce(F.log(F.col("weight") * F.col("base")), F.lit(0.0)).alias("log")))


@tidy
def answer_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slice, shard, logs for rows, see ASKED, that come sorted by shard, behind rows lang, gram, log of it."""
    own, known, parts, h, logs = None, False, [], None, None
    for batch in batches:
        out: list[list] = [[], [], []]
        shard, lang = batch.column("shard").to_numpy(), batch.column("lang")
        fact = lang.is_valid().to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (fact[1:] != fact[:-1]), [True]])) if len(shard) else [0]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if shard[a] != own:
                own, known, parts = shard[a], False, []
            piece = batch.slice(a, b - a)
            if fact[a]:
                cp = np.frombuffer("".join(piece.column("gram").to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, ORDER)
                parts.append((_hashes(piece.column("lang").to_numpy(), cp), piece.column("log").to_numpy().astype(np.float32)))
                continue
            if not known:
                h, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(h)
                h, logs, known, parts = h[order], logs[order], True, []
            for s, langs, grams in zip(*(piece.column(c).to_pylist() for c in ("slice", "langs", "grams")), strict=True):
                got = logs[np.searchsorted(h, _unpacked(langs, grams, None)[0])]
                out[0].append(s)
                out[1].append(int(own))
                out[2].append(got.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["slice", "shard", "logs"])


def score(held: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    """doc_id, lang, short, perplexity of the documents of a slice."""
    if not len(held):
        return pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.int32()), "short": pa.array([], pa.bool_()), "perplexity": pa.array([], pa.float64())})
    langs = np.frombuffer(held.column("langs")[0].as_py(), dtype=np.uint8)
    sizes = np.frombuffer(held.column("sizes")[0].as_py(), dtype="<i8")
    runs, known = [], []
    for b in blocks(_texts(held), langs):
        runs.append((b.h, b.n, b.own))
        known.append(b.h)
        if sum(map(len, known)) > KINDS + 2 * len(known[0]):
            known = [np.unique(np.concatenate(known))]
    h = np.unique(np.concatenate(known)) if known else np.zeros(0, dtype=U)
    logs = np.zeros(len(h), dtype=np.float64)
    got = dict(zip(answers.column("shard").to_pylist(), answers.column("logs").to_pylist(), strict=True))
    for shard, rows in _by_shard(h, shards):
        logs[rows] = np.frombuffer(got[shard], dtype="<f4")
    total = np.zeros(len(langs))
    for own_h, n, own in runs:
        total += np.bincount(own, weights=np.repeat(logs[np.searchsorted(h, own_h)], n), minlength=len(langs))
    perplexity = np.exp(-total / np.maximum(sizes, 1))
    return pa.table({"doc_id": held.column("ids")[0].values, "lang": pa.array(langs.astype(np.int32)), "short": pa.array(sizes < SHORT), "perplexity": pa.array(perplexity, mask=sizes == 0)})


def perplexities(slim: DataFrame, good: DataFrame) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """doc_id, lang, short, perplexity of slim(doc_id, lang, text), with the model trained on its documents
    in good(doc_id), a row each time one counts; and the model."""
    shards = max(SHARDS, int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = bucketed(slim.mapInArrow(pack_batches, HELD), buckets(slim.sparkSession), "slice")
    places = held.select(F.col("slice").alias("place"), F.posexplode("ids").alias("pos", "doc_id")).where("doc_id IS NOT NULL")
    # Labels grow with the documents, so this is a merge join at every size.
    marks = places.join(good.hint("merge"), "doc_id").groupBy("place", "pos").agg(F.count("*").alias("times"))
    asked = written(held.groupBy("slice").cogroup(marks.groupBy("place")).applyInArrow(lambda a, b: ask(a, b, shards), ASKED))
    dealt = asked.select("shard", "langs", "grams", "times").repartition(F.col("shard")).sortWithinPartitions("shard")
    grams = written(dealt.mapInArrow(add_batches, "shard int, lang int, gram string, n long"))
    model = probabilities(grams.where("n > 0").select("lang", "gram", "n"))
    logs = logarithms(grams.select("shard", "lang", "gram"), model)
    both = asked.select("shard", "slice", "langs", "grams").unionByName(logs, allowMissingColumns=True)
    both = both.repartition(F.col("shard")).sortWithinPartitions("shard", F.col("lang").asc_nulls_last())
    answers = both.mapInArrow(answer_batches, "slice long, shard int, logs binary")
    shape = "doc_id long, lang int, short boolean, perplexity double"
    return held.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(lambda a, b: score(a, b, shards), shape), model


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of every row of docs(doc_id, text, lang), the model and
    the thresholds learned from labels(doc_id, quality)."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lang(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text"))
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    out_of = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0
    scored = written(perplexities(slim, good.where(~out_of))[0])
    trusted = scored.join(good.hint("merge"), "doc_id")
    at = F.percentile_approx("perplexity", quantile, 10000)
    limits = trusted.groupBy("lang", "short").agg(F.coalesce(F.percentile_approx(F.when(out_of, F.col("perplexity")), quantile, 10000), at).alias("threshold"))
    out = scored.join(F.broadcast(limits), ["lang", "short"], "left")  # ten rows at most
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    lang = F.coalesce(F.get(F.array(*map(F.lit, LANGUAGES)), F.col("lang")), F.lit("zz"))
    return out.select("doc_id", lang.alias("lang"), F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), kept.alias("kept"))
