import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mapstats.llm import substring_dedup as S


def brute(rows, window):
    """rows: distinct ids, no nulls."""
    first, words = {}, {}
    for i, t in sorted(rows):
        words[i] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), (i, s))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (i, s):
                gone |= set(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    words = lambda n, v=3000: [f"w{r.randrange(v)}" for _ in range(n)]
    passages = [words(r.randint(18, 70)) for _ in range(6)]
    rows = [(500, None), (501, ""), (502, "a b"), (503, "ä " * 90), (504, "x y " * 60), (505, " ".join(words(19))), (507, "same"), (506, "same")]
    for i in range(150):
        w = []
        for _ in range(r.randint(1, 4)):
            w += words(r.randint(0, 60)) if r.random() < 0.6 else r.choice(passages)
        rows.append((i * 37 % 151, " ".join(w) + "\n" * (i % 3)))
    return rows + [(600 + k, rows[20][1]) for k in range(5)] + [(700, " ".join(words(100, 3))), (701, " ".join(words(300, 2)))]


@pytest.mark.parametrize(("window", "group", "most", "chunk"), [(20, S.GROUP, S.SUBTREE, S.CHUNK), (20, 3, 4, 500), (8, 2, 1, 200), (20, 40, 60, 500)])
def test_equals_brute_force(spark, monkeypatch, window, group, most, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = corpus(window + group)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, window)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.digests(docs, window, group=group, most=most).collect()}
    assert got == want
    texts = {r.doc_id: r.text for r in S.deduped(docs, window, group=group, most=most).collect()}
    assert {i: hashlib.sha256(" ".join((t or "").split()).encode()).hexdigest() for i, t in texts.items()} == {i: v[2] for i, v in want.items()}


def test_nulls_repeats_and_empty(spark):
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 2), (9, text, 3)], "doc_id long, text string, n_words int")
    assert sorted((str(r.doc_id), r.n_removed) for r in S.digests(docs).collect()) == [("4", 0), ("4", 0), ("9", 40), ("None", 40)]
    assert S.deduped(docs).schema == docs.schema
    assert S.digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 8, 20])
def test_subtree_equals_brute_force(window):
    r = random.Random(window)
    for _ in range(60):
        rows = [[r.choice("ab" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randint(1, 70))] for _ in range(r.randint(1, 8))]
        group = sorted(r.randrange(3) for _ in rows)
        tree = S.Subtree(pa.array([" ".join(w).encode() for w in rows], pa.large_binary()), np.array(group), window)
        seen, want = set(), []
        for g, w in zip(group, rows, strict=True):
            for s in range(len(w)):
                leaf = (g, *w[s : s + window])
                want.append(s + window <= len(w) and leaf in seen)
                if s + window <= len(w):
                    seen.add(leaf)
        assert tree.repeat.tolist() == want
        assert tree.start.tolist() == [sum(map(len, rows[:k])) for k in range(len(rows))]


def test_texts_without_an_id(spark, monkeypatch):
    """They share one id, come last, in the order of a hash of their texts, and find each other."""
    monkeypatch.setattr(S, "CHUNK", 60)
    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(None, f"{k} {shared} {k * 7}") for k in range(80)] + [(None, "w " * 200)] * 3 + [(5, shared), (5, "other " + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = S.digests(docs, group=5, most=7).collect()
    without = [r.n_removed for r in got if r.doc_id is None]
    own = brute([(0, "w " * 200)], 20)[0][1]
    assert sorted(without) == sorted([25] * 80 + [own] * 3)
    assert sorted(r.n_removed for r in got if r.doc_id == 5) == [0, 25]


def test_very_long_text(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    text = " ".join(words + words[1000:2000] + ["x"] * 50_000)
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[:30_000]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in S.digests(docs).collect()}
    assert got == {d: v[:2] for d, v in brute([(1, text), (2, " ".join(words[:30_000]))], 20).items()}
