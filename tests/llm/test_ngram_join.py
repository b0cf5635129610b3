import random

import numpy as np
import pyarrow as pa
import pytest

from mapstats.llm import ngram_join as N
from mapstats.llm.hashing import by_key, shingle_set, shingles


def brute(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for p in range(len(sets)):
        for q in range(p):
            (i, x), (j, y) = sets[p], sets[q]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted((str(i), len(s), str(top(i) if i is not None else None)) for i, s in sets)


def corpus(seed, n=220):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of"] * 60
    text = lambda m: [r.choice(vocab) for _ in range(m)]
    base = [text(r.randint(1, 200)) for _ in range(25)]
    hot = text(60)
    passage = text(40)
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.5 else list(hot) if r.random() < 0.6 else text(r.randint(3, 60)) + passage
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i * 7 % 1000, " ".join(w).upper() if r.random() < 0.1 else " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "one two"), (2005, " \n"), (None, "one two"), (2006, "a b c"), (2006, "a b c"), (2007, "é " * 50), (3000, rows[0][1]), (3000, rows[5][1])]
    return rows


@pytest.mark.parametrize(("k", "percent", "frequent", "long", "block"), [(5, 80, 8, 128, 4096), (3, 90, 8, 30, 16), (2, 60, 4, 20, 8)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, frequent, long, block):
    for name, value in (("FREQUENT", frequent), ("LONG", long), ("BLOCK", block)):
        monkeypatch.setattr(N, name, value)
    rows = corpus(k * 100 + percent)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in N.join(docs, k, percent).collect())
    assert got == brute(rows, k, percent)
    kept = N.keep_one(docs, k, percent)
    assert kept.columns == docs.columns
    assert sorted({str(r.doc_id) for r in kept.collect()}) == sorted({i for i, _, c in got if i == c})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.join(docs).count() == 0 and N.keep_one(docs).count() == 0
    clash = spark.createDataFrame([(1, "a b", 3, "x"), (2, "a b", 4, "y")], "doc_id long, text string, __gone long, component_id string")
    assert [tuple(r) for r in N.keep_one(clash).collect()] == [(1, "a b", 3, "x")]


@pytest.mark.parametrize("few", [1, 16])
def test_long_documents_with_chance_phrases(spark, monkeypatch, few):
    """Long documents about the threshold apart, families that overlap, and phrases that strangers share."""
    for name, value in (("FREQUENT", 16), ("LONG", 40), ("FEW", few)):
        monkeypatch.setattr(N, name, value)
    r = random.Random(12)
    text = lambda m: [f"w{r.randrange(5000)}" for _ in range(m)]
    base, phrase, rows = [text(r.randint(60, 400)) for _ in range(12)], text(7), []
    for i in range(110):
        w = list(r.choice(base)) if i % 3 else text(r.randint(60, 400)) + phrase
        for _ in range(r.randint(0, max(1, len(w) // 12)) // 3):
            w[r.randrange(len(w))] = f"w{r.randrange(5000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in N.join(docs, 2, 80).collect())
    assert got == brute(rows, 2, 80)


def test_long_sets_that_meet_on_few_keys_have_no_partner(spark):
    least = 1 + N.needed(1000, 80) // N.SPARE
    rows = [(k, 1, 1000) for k in range(least - 1)] + [(k, 2, 1000) for k in range(least)] + [(0, 3, 160), (1, 4, 161)]
    found = spark.createDataFrame([*rows, rows[0]], "key long, digest long, n long")
    assert {r.digest for r in N.enough(found, 80).collect()} == {2, 3}
    assert N.enough(found, 80).count() == least + 1


def test_large_buckets_and_groups(spark, monkeypatch):
    """One group of near copies holds a third of all rows; buckets, homes and verified parts are cut small."""
    for name, value in (("FREQUENT", 4), ("LONG", 40), ("BLOCK", 8), ("TOKENS", 300), ("ROWS", 60)):
        monkeypatch.setattr(N, name, value)
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    hot, other = [r.choice(vocab) for _ in range(50)], [r.choice(vocab) for _ in range(36)]
    rows = []
    for i in range(240):
        w = list(hot) if i % 3 == 0 else list(other) if i % 3 == 1 else [r.choice(vocab) for _ in range(r.randint(3, 50))] + hot[:30]
        for _ in range(r.choice([0, 1, 1, 2])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, percent in ((1, 80),):
        got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in N.join(docs, k, percent).collect())
        assert got == brute(rows, k, percent)


def test_partners_equal_all_pairs():
    r = np.random.default_rng(3)
    for trial in range(60):
        m = int(r.integers(1, 120))
        key, n = r.integers(0, 4, m), r.integers(2, 30, m)
        order = np.lexsort((n, key))
        key, n = key[order], n[order]
        sign = r.integers(0, 3, (m, 16)).astype(np.uint8)
        name, room, guest = r.integers(0, 3, m), r.integers(0, 30, m), (r.random(m) < 0.3) & (trial % 2 == 1)
        want = np.zeros(m, dtype=bool)
        for i in range(m):
            for j in range(i):
                near = 100 * n[j] >= 80 * n[i] and int(np.abs(sign[i].astype(int) - sign[j]).sum()) * 180 <= (n[i] + n[j]) * 20
                if key[i] == key[j] and near and name[i] != name[j] and room[i] != room[j] and (guest[i] != guest[j] or not guest.any()):
                    want[i] = want[j] = True
        assert (N.partnered(key, n, sign, name, room, guest, 80) == want).all()


def test_gap_is_no_more_than_the_difference():
    r = np.random.default_rng(5)
    for _ in range(50):
        pool = r.integers(0, 2**63, 600, dtype=np.uint64)
        x, y = (np.unique(r.choice(pool, int(r.integers(1, 600)))) for _ in "xy")
        packed = N._unpacked(np.stack([N._signature(x), N._signature(y)]))
        assert (packed == np.stack([N._counts(x, N.BINS), N._counts(y, N.BINS)])).all()
        assert N._gap(packed[:1], packed[1:])[0] <= len(np.setxor1d(x, y))


def test_pairs_meet_at_their_least_key():
    r = np.random.default_rng(5)
    for _ in range(30):
        keys = [np.unique(r.integers(0, 12, int(r.integers(1, 8)))) for _ in range(20)]
        key = np.array([x[int(r.integers(len(x)))] for x in keys])
        a, b = np.triu_indices(20, 1)
        both = key[a] == key[b]
        a, b = a[both], b[both]
        want = [min(set(keys[x]) & set(keys[y])) == key[x] for x, y in zip(a, b, strict=True)]
        assert N.shared_before(key, keys)(a, b).tolist() == want


def test_forest_joins_what_links():
    r = random.Random(6)
    for _ in range(40):
        sets = sorted((np.unique(np.array([r.randrange(40) for _ in range(r.randint(2, 40))], dtype=N.U)) for _ in range(25)), key=len)
        n = np.array([len(s) for s in sets])
        up = list(range(25))
        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 70 * (n[i] + n[j] - both):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        links = N.forest(np.arange(25), n, sets, np.arange(25), np.arange(25), 70)
        own = list(range(25))
        for a, b in links:
            x, y = own[a], own[b]
            assert x != y
            own = [min(x, y) if z in (x, y) else z for z in own]
        assert own == up


def test_links_whose_prefixes_straddle_a_block(spark, monkeypatch):
    """Of two long documents with prefixes of frequent tokens, one has a token of many blocks in its own."""
    vocab = [f"w{i}" for i in range(140)]
    least = int(N.shingles(" ".join(vocab), 1)[1])
    other = next(w for w in (f"x{i}" for i in range(10**5)) if int(N.shingles(w + " w0", 1).min()) < least and w not in vocab)
    texts = [" ".join(vocab), " ".join([*vocab[1:], other])]
    one, two = (N.shingles(t, 1) for t in texts)
    assert 100 * len(np.intersect1d(one, two)) >= 90 * len(np.union1d(one, two))
    frequent = np.union1d(one, two)
    (many,) = np.setdiff1d(two, one)
    monkeypatch.setattr(N, "frequent_class", lambda rows: (frequent, np.where(frequent == many, 3, 1)))
    got = N.join(spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string"), 1, 90).collect()
    assert [r.component_id for r in got] == [1, 1]


def test_very_long_text(spark):
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    near = words[:60_000] + ["x"] + words[60_001:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, "a b c d")]
    got = {x.doc_id: x.component_id for x in N.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {5: 3, 3: 3, 4: 4}


def test_hashes_agree_with_words():
    r = random.Random(4)
    for _ in range(200):
        t = " ".join(r.choice("abcAB") for _ in range(r.randint(0, 30)))
        assert len(shingles(t, 3)) == len(shingle_set(t, 3))


def test_by_key_keeps_keys_together():
    r = random.Random(2)
    for _ in range(100):
        keys = sorted(r.choice(range(6)) for _ in range(r.randint(0, 40)))
        batches, at = [], 0
        while at < len(keys):
            m = r.randint(1, 9)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + m], pa.int64())], names=["key"]))
            at += m
        got = [t.column("key").to_pylist() for t in by_key(batches, "key")]
        assert [x for g in got for x in g] == keys
        assert all(a[-1] < b[0] for a, b in zip(got, got[1:], strict=False))
        assert np.all([len(g) > 0 for g in got])
