import math
import random
import re
import time
import zlib

from mapstats.llm import toxicity as T


def matcher():
    return T.matcher(tuple(T.TERMS), tuple(T.EXCEPTIONS))


def count(text):
    return sum(matcher().hits(text).values())


def test_folding_and_bounds():
    assert count("You IDIOT!!") == 1
    assert count("you 1d10t, w0rth1ess sсum$$$") == 3  # a Cyrillic letter in the last
    assert count("ｉｄｉｏｔ and estúpido estupido") == 3
    assert count("idiotic trashy clownish") == 0
    assert count("put it in the trash can; total trash") == 1
    assert count("") == 0
    assert len(T.fold("İstanbul ﬁ ß 漢🙂")) == len("İstanbul ﬁ ß 漢🙂")


def test_score(spark):
    rows = [(i, ("an idiot and a moron " if i % 5 == 0 else "a fine day ") + "word " * (i % 7 * 40), "x") for i in range(400)]
    docs = spark.createDataFrame(rows + [(None, None, None), (400, "", "x"), (400, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(400)] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = T.score(docs, labels).collect()
    assert len(got) == 403
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == (r.doc_id % 5 == 0)
    assert T.score(docs.limit(0), labels).count() == 0
    assert T.score(docs, labels.limit(0)).count() == 403


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame([(i, "scum " * (i % 3), "s") for i in range(200)], "doc_id long, text string, source string")
    one = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, toxic int")
    flipped = one.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["x"]).expr("case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end"))
    a, b = ({r.doc_id: r.score for r in T.score(docs, x).collect()} for x in (one, flipped))
    assert a == b


def brute_hits(text, terms, exceptions):
    """Every term at every place, one by one."""
    folded, out = T.fold(text), {}
    first = {}
    for k, t in enumerate(terms):
        first.setdefault(T.fold(t), k)

    def places(s):
        return [i for i in range(len(folded) - len(s) + 1) if folded[i : i + len(s)] == s and not (i and text[i - 1].isalnum()) and not (i + len(s) < len(text) and text[i + len(s)].isalnum())]

    covers = [(i, i + len(T.fold(e))) for e in exceptions for i in places(T.fold(e))]
    for t, k in first.items():
        n = sum(not any(a <= i and i + len(t) <= b for a, b in covers) for i in places(t))
        if n:
            out[k] = n
    return out


def corpus(n, seed):
    r = random.Random(seed)
    bits = ["idiot", "1d10t", "trash", "trash can", "clown", "circus clown", "le clown", "filthy", "filthy rich", "rich", "jerk", "chicken", "day", "sunny", "zorgle", "a", ".", "sore loser", "l0ser"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(0, 60)))) for i in range(n)]
    return rows, [(i, int(len(re.findall("idiot|zorgle|trash", t)) > len(t.split()) / 6)) for i, t in rows]


def test_hits_equal_brute_force():
    terms, phrases = ("idiot", "trash", "clown", "filthy", "jerk", "loser", "can", "ldiot"), ("trash can", "circus clown", "le clown", "filthy rich", "sore loser", "clown le clown")
    for _, t in corpus(400, 4)[0]:
        assert T.Matcher(list(terms), list(phrases)).hits(t) == brute_hits(t, terms, phrases), t


def test_scores_equal_brute_force(spark):
    """Weights, length rule, curve and mined terms from the rows that are not held out, in plain Python."""
    rows, labels = corpus(500, 9)
    got = {r.doc_id: r for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    train = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    total = [sum(y == k for _, y in train) for k in (0, 1)]
    count = {}
    for t, y in train:
        for w in {T.fold(x) for x in T.WORDS.findall(t)}:
            count.setdefault(w, [0, 0])[y] += 1
    odds = lambda good, bad: math.log((bad + 0.5) / (total[1] + 1)) - math.log((good + 0.5) / (total[0] + 1))
    known = {T.fold(t) for t in T.TERMS}
    mined = [w for w, (g, b) in count.items() if b >= T.LEAST_DOCS and len(w) > 2 and odds(g, b) >= T.LEAST_ODDS and w not in known]
    terms = [*T.TERMS, *mined]
    hits = {t: brute_hits(t, terms, T.EXCEPTIONS) for _, t in rows}
    weights = [T.PRIOR[0]] * len(terms)
    for k in range(len(terms)):
        own = [y for t, y in train if k in hits[t]]
        if own:
            weights[k] = odds(own.count(0), own.count(1))
    load = {t: sum(weights[k] * math.log1p(n) for k, n in hits[t].items()) / (1 + math.log1p(len(t.split()) / T.LENGTH) / 4) for _, t in rows}
    a, b = -1.0, 0.5
    x = [(min(math.floor(load[t] / T.WIDTH), T.BINS) * T.WIDTH, y) for t, y in train]
    for _ in range(200):
        p = [1 / (1 + math.exp(-(a + b * v))) for v, _ in x]
        ga, gb = sum(y - q for (_, y), q in zip(x, p, strict=True)), sum((y - q) * v for (v, y), q in zip(x, p, strict=True)) - b
        haa, hab, hbb = sum(q * (1 - q) for q in p), sum(q * (1 - q) * v for (v, _), q in zip(x, p, strict=True)), sum(q * (1 - q) * v * v for (v, _), q in zip(x, p, strict=True)) + 1
        det = haa * hbb - hab * hab
        a, b = a + max(-1, min(1, (hbb * ga - hab * gb) / det)), b + max(-1, min(1, (haa * gb - hab * ga) / det))
    for i, t in rows:
        want = 1 / (1 + math.exp(-(a + b * load[t])))
        assert abs(got[i].score - want) < 1e-4, (i, got[i].score, want)


def test_very_long_text_takes_linear_time():
    times = []
    for n in (20_000, 160_000):
        start = time.perf_counter()
        assert count("trash can idiot " * n) == n
        times.append(time.perf_counter() - start)
    assert times[1] < 40 * times[0]
