"""Toxicity by a weighted lexicon: folded text, Aho-Corasick, exception phrases, length.

Every text is folded character by character (case, accents, homoglyphs, digit substitutions;
1, i and l fall together), so places in the folded text are places in the text. One automaton
finds all terms and exception phrases; a term counts if no letter or digit touches it in the
text and no exception phrase covers it. A term's weight is its log-odds between toxic and
other labelled documents; the weighted, damped counts, divided by a slowly growing function
of the length, go through a logistic curve fitted to the same labels.

Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2 only; lang, source
and doc_id are no inputs of a score. What is gathered on the driver is bounded by the lexicon
(MOST_TERMS mined terms, two counts a term) and by BINS (two counts a bin).

Defined results: a null or empty text has no hits and the score of such texts. A null doc_id
is not held out and has no label. Rows are scored one by one, repeated rows and ids included;
a document labelled twice counts twice. Null labels are left out; without labels of both
kinds, weights and curve are those of PRIOR. Empty tables give empty tables. Other columns,
of any name, are left out.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy, written

#: The terms.
TERMS = """idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns
imbecile imbeciles dumb dumbass retard retarded filth filthy vermin parasite parasites jerk bastard bitch asshole
arschloch dummkopf abschaum trottel vollidiot wichser schwachkopf
connard connasse salaud abruti ordure imbécile crétin débile
estúpido estúpida idiota imbécil basura escoria gilipollas cabrón payaso""".split()
#: Phrases in which a term is harmless.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "trash pickup", "clown fish", "circus clown", "idiot proof", "idiot-proof", "sore loser", "host and parasite", "parasite load", "filthy rich", "dumb bell", "jerk chicken", "jerk seasoning", "le clown"]
#: Characters that look like Latin letters, and substituted digits and signs.
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "β": "b", "ь": "b", "с": "c", "ϲ": "c", "ԁ": "d", "ɗ": "d", "е": "e", "ё": "e", "ε": "e", "є": "e", "ɡ": "g", "һ": "h", "н": "h",
    "і": "i", "ї": "i", "ι": "i", "ı": "i", "ӏ": "i", "ј": "j", "к": "k", "κ": "k", "м": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "ө": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q",
    "г": "r", "ѕ": "s", "ʂ": "s", "т": "t", "τ": "t", "υ": "u", "μ": "u", "ц": "u", "ѵ": "v", "ν": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ʏ": "y", "ø": "o", "ł": "i", "đ": "d",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "l": "i",
}
PRIOR = (1.5, -4.0, 4.0)  # a term's weight; intercept and slope of the curve
SAMPLE = 20_000  # labelled rows, the least hashes of doc_id, from which terms are mined
LEAST_DOCS, LEAST_ODDS, MOST_TERMS = 5, 2.5, 4000  # toxic documents and log-odds of a mined term; mined terms
LENGTH = 400.0  # words at which the length begins to count
BINS = 256
WIDTH = 0.05


def _fold_table() -> dict[int, str]:
    """Every Latin, Greek, Cyrillic and full-width letter to its folded form, by its decomposition."""
    out: dict[int, str] = {}
    for a, b in ((0x20, 0x250), (0x370, 0x530), (0x1D00, 0x2000), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for cp in range(a, b):
            c = unicodedata.normalize("NFKD", chr(cp))[:1].lower()[:1]
            c = LOOKALIKES.get(c, c)
            if c and c != chr(cp):
                out[cp] = c
    out |= {ord(k): v for k, v in LOOKALIKES.items()}
    return out


FOLD = _fold_table()


WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The same number of characters, folded."""
    return text.translate(FOLD)


class Matcher:
    def __init__(self, terms: list[str], exceptions: list[str]):
        self.automaton = ahocorasick.Automaton()
        merged: dict[str, int] = {}
        for k, t in enumerate(terms):
            merged.setdefault(fold(t), k)
        for s, k in merged.items():
            self.automaton.add_word(s, (k, len(s)))
        for s in {fold(e) for e in exceptions}:
            self.automaton.add_word(s, (-1, len(s)))
        self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, int]:
        """Times that each term counts."""
        found, covers = [], []
        for end, (k, n) in self.automaton.iter(fold(text)):
            start = end - n + 1
            if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            (covers if k < 0 else found).append((start, end, k))
        found.sort()
        covers.sort()
        out: dict[int, int] = {}
        at, reach = 0, -1  # of the phrases that start no later, how far they go
        for a, b, k in found:
            while at < len(covers) and covers[at][0] <= a:
                reach = max(reach, covers[at][1])
                at += 1
            if b > reach:
                out[k] = out.get(k, 0) + 1
        return out


_matchers: dict[tuple, Matcher] = {}


def matcher(terms: tuple[str, ...], exceptions: tuple[str, ...]) -> Matcher:
    if (terms, exceptions) not in _matchers:
        _matchers[terms, exceptions] = Matcher(list(terms), list(exceptions))
    return _matchers[terms, exceptions]


@tidy
def hit_batches(batches: Iterable[pa.RecordBatch], terms: tuple[str, ...], exceptions: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    m = matcher(terms, exceptions)
    for batch in batches:
        n_words, hits = [], []
        for x in batch.column("text"):
            text = x.as_py() or ""
            n_words.append(len(text.split()))
            hits.append(list(m.hits(text).items()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, pa.map_(pa.int32(), pa.int32()))], names=["doc_id", "n_words", "hits"])


def hits(docs: DataFrame, terms: list[str] = TERMS, exceptions: list[str] = EXCEPTIONS) -> DataFrame:
    """doc_id, n_words, hits (number of the term -> times) of every whole text."""
    ship(docs.sparkSession)
    t, e = tuple(terms), tuple(exceptions)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda b: hit_batches(b, t, e), "doc_id long, n_words long, hits map<int,int>")


@tidy
def word_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folded words, with the toxic and the other documents that have them, added up over a partition."""
    bad: dict[str, int] = {}
    good: dict[str, int] = {}
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            own = bad if toxic else good
            for w in {fold(x) for x in WORDS.findall(text.as_py() or "")}:
                own[w] = own.get(w, 0) + 1
    every = [*bad, *(w for w in good if w not in bad)]
    for at in range(0, len(every), 50_000):
        part = every[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([bad.get(w, 0) for w in part], pa.int64()), pa.array([good.get(w, 0) for w in part], pa.int64())], names=["word", "bad", "good"])


def mine(docs: DataFrame, gold: DataFrame) -> list[str]:
    """Words that mark toxic documents, of a bounded sample of labelled rows."""
    sample = gold.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = texts.join(F.broadcast(sample), "doc_id").select("text", "toxic")  # at most SAMPLE ids
    found = labelled.mapInArrow(word_batches, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("good") + 0.5) / (totals[0] + 1.0))
    best = found.where((F.col("bad") >= LEAST_DOCS) & (F.length("word") > 2)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    return [r["word"] for r in best.orderBy(F.desc(F.col("odds") * F.col("bad")), "word").limit(MOST_TERMS).collect()]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _load(weights: list[float]):
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = F.aggregate(F.map_entries("hits"), F.lit(0.0), lambda acc, e: acc + F.get(table, e["key"]) * F.log1p(e["value"].cast("double")))
    return weighed / (1.0 + F.log1p(F.col("n_words") / LENGTH) / 4.0)


def _logistic(bins: list[tuple[float, int, int]], ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope from (x, label, rows), by Newton's method with a penalty on the slope."""
    x, y, n = (np.array(v, dtype=float) for v in zip(*bins, strict=True))
    a, b = PRIOR[1], 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([np.sum(n * (y - p)), np.sum(n * (y - p) * x) - ridge * b])
        v = n * p * (1 - p)
        h = np.array([[np.sum(v) + 1e-6, np.sum(v * x)], [np.sum(v * x), np.sum(v * x * x) + ridge]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, terms: list[str] = TERMS, exceptions: list[str] = EXCEPTIONS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text), learned from labels(doc_id, toxic)."""
    gold = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    ship(docs.sparkSession)
    known = {fold(t) for t in terms}
    terms = [*terms, *(w for w in mine(docs, gold) if w not in known)]
    found = written(hits(docs, terms, exceptions))  # a short row a document
    train = found.join(gold, "doc_id").select("n_words", "hits", "toxic")
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    weights = [PRIOR[0]] * len(terms)
    a, b = PRIOR[1:]
    if totals.get(0) and totals.get(1):
        per = train.select("toxic", F.explode(F.map_keys("hits")).alias("term")).groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()
        for r in per:
            bad, good = r["bad"], r["n"] - r["bad"]
            weights[r["term"]] = math.log((bad + 0.5) / (totals[1] + 1)) - math.log((good + 0.5) / (totals[0] + 1))
        binned = train.groupBy(F.least(F.floor(_load(weights) / WIDTH), F.lit(BINS)).cast("int").alias("bin"), "toxic").agg(F.count("*").alias("n")).collect()
        a, b = _logistic([(r["bin"] * WIDTH, r["toxic"], r["n"]) for r in sorted(binned)])
    p = 1.0 / (1.0 + F.exp(-(F.lit(a) + F.lit(b) * _load(weights))))
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), p.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
