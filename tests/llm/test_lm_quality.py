import random
from collections import Counter, defaultdict
from math import exp, log

import numpy as np
import pyarrow as pa
import pytest

from mapstats.llm import lm_quality as L

N = L.ORDER


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and", "ering", "thon", "ation", "is", "çà"]) for _ in range(n)) + "."


def grams(text):
    padded = L.PAD * (N - 1) + text
    return [padded[i : i + N] for i in range(len(text))]


def brute(texts):
    """Modified Kneser-Ney by the formula."""
    counts = {N: Counter(g for t in texts for g in grams(t))}
    for k in range(N - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d, by_context = {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        n1 = max(n[1], 1)
        y = n1 / (n1 + 2 * n[2])
        d[k] = []
        for i in (1, 2, 3):
            ni = n1 if i == 1 else n[i]
            v = i - (i + 1) * y * n[i + 1] / ni if ni else 0.5 * i
            d[k].append(max(0.1, min(v, i - 0.05)))
        by_context[k] = defaultdict(list)
        for g, x in c.items():
            by_context[k][g[:-1]].append(x)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        lower = p(gram[1:])
        own = by_context[k].get(gram[:-1])
        if not own:
            return lower
        rest = sum(d[k][min(c, 3) - 1] for c in own) / sum(own)
        c = counts[k].get(gram, 0)
        return (max(c - d[k][min(c, 3) - 1], 0) / sum(own) if c else 0) + rest * lower

    return p


def perplexity(p, text):
    return exp(-sum(log(p(g)) for g in grams(text)) / len(text))


def test_slices_hold_the_texts(monkeypatch):
    monkeypatch.setattr(L, "SLICE", 100)
    monkeypatch.setattr(L, "DOCS", 3)
    texts = [None, "", "ä" * 250, "b", "c\x00", "d", "e" * 99, "漢\U0001f600"]
    rows = pa.RecordBatch.from_pydict({"doc_id": [None, *range(7)], "lang": [4] * 8, "text": texts})
    out = [pa.Table.from_batches([b]) for b in L.pack_batches([rows.slice(0, 5), rows.slice(5)])]
    assert len({t.column("slice")[0].as_py() for t in out}) == len(out) > 3
    assert [x for t in out for x in L._texts(t)] == [t or "" for t in texts]
    assert [x for t in out for x in t.column("ids")[0].as_py()] == [None, *range(7)]


def test_perplexities_equal_the_formula(spark):
    r = random.Random(1)
    texts = {i: ("en" if i % 3 else "fr", prose(r, r.randrange(1, 30))) for i in range(30)}
    texts |= {40: ("en", "zq the! 漢字\x00 x\n" * 9), 41: ("en", ""), 42: ("en", None), 43: ("de", "der"), 44: ("en", prose(r, 900)), 45: ("fr", "a")}
    docs = spark.createDataFrame([(i, lang, t) for i, (lang, t) in texts.items()], "doc_id long, lang string, text string")
    slim = docs.select("doc_id", L._lang(docs["lang"]).alias("lang"), "text")
    trained = [i for i in range(30) if i % 4] + [2, 42]  # 2 counts twice
    scored, model = L.perplexities(slim, spark.createDataFrame([(i,) for i in trained], "doc_id long"))
    got = {x.doc_id: x for x in scored.collect()}
    assert set(got) == set(texts)
    for n, lang in ((1, "en"), (3, "fr")):
        p = brute([texts[i][1] for i in trained if texts[i][0] == lang and texts[i][1]])
        for i, (own, text) in texts.items():
            if own == lang and text:
                assert got[i].perplexity == pytest.approx(perplexity(p, text), rel=1e-5)
                assert got[i].short == (len(text) < L.SHORT)
        for k, (seen, _) in enumerate(model, 1):
            for x in seen.where(f"lang = {n}").collect():
                assert len(x.gram) == k and x.p == pytest.approx(p(x.gram))
    assert got[41].perplexity is None and got[42].perplexity is None and got[43].perplexity == 1


def test_what_is_gathered_grows_with_the_text(spark):
    r = random.Random(4)

    def kinds(n):
        rows = [(i, 1, "".join(r.choice("abcdefgh") for _ in range(200))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, lang int, text string")
        return L.perplexities(docs, docs.select("doc_id"))[1][-1][0].count()

    assert kinds(40) > 3 * kinds(10)


def test_classify(spark):
    r = random.Random(2)
    rows = [(i, prose(r, 60) if i % 10 else "#$% QX!! " * 40, "en", 1) for i in range(200)]
    rows += [(300, None, "en", 1), (301, "", None, 1), (None, prose(r, 50), "en", 1), (302, "漢字かな", "xx", 1), (303, prose(r, 50), "en", 1), (303, prose(r, 50), "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity int")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(150)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = L.classify(docs, labels).collect()
    got = {(-1 if x.doc_id is None else x.doc_id): x for x in out}
    assert len(out) == len(rows)
    limit = got[1].threshold
    held_out = [x[0] for x in docs.selectExpr("doc_id").where(f"pmod(xxhash64(doc_id), {L.HOLD_OUT}) = 0 AND doc_id < 150 AND doc_id % 10 > 0").collect()]
    assert limit == max(got[i].perplexity for i in held_out)  # of under 200, the quantile is the greatest; it is kept
    assert all(got[i].kept for i in held_out)
    for x in out:
        if x.perplexity is not None and x.threshold is not None:
            assert x.kept == (x.perplexity <= x.threshold)
    assert not any(got[i].kept for i in range(0, 200, 10))
    assert sum(got[i].kept for i in range(200) if i % 10) > 160
    assert not got[300].kept and got[300].perplexity is None and not got[301].kept
    assert got[302].kept and got[302].threshold is None and got[302].lang == "zz"
    assert L.classify(docs.limit(0), labels).count() == 0
    assert L.classify(docs, labels.limit(0)).where("kept").count() == len(rows) - 2


def test_grams_of_a_long_text_in_blocks(monkeypatch):
    text, langs = prose(random.Random(3), 500) + "漢\U0001f600", np.zeros(1, dtype=np.uint8)
    one = L.slice_grams(L.blocks([text], langs), langs, np.ones(1, dtype=np.int64))
    monkeypatch.setattr(L, "BLOCK", 97)
    monkeypatch.setattr(L, "KINDS", 40)
    many = L.slice_grams(L.blocks([text], langs), langs, np.ones(1, dtype=np.int64))
    assert all((a == b).all() for a, b in zip(one, many, strict=True))
    assert Counter(dict(zip(L._strings(one[2]), one[3].tolist(), strict=True))) == Counter(grams(text))
