import hashlib
import math
import re
import zlib

import pytest

from mapstats.llm import importance as I

SCHEMA = "doc_id long, text string, score string, rank string, tie int, part int"


def docs():
    out = [(k, " ".join(f"W{(k * j) % 37}" for j in range(k % 45)), "x", "x", 0, 0) for k in range(200)]
    out += [(500, None, "x", "x", 0, 0), (501, "", "x", "x", 0, 0), (502, "Été-été ÉTÉ_x1 \x00y\x7fz " * 8, "x", "x", 0, 0)]
    out += [(7, "w1 w2 " * 15, "x", "x", 0, 0)] * 3 + [(None, "w3 " * 25, "x", "x", 0, 0), (600, "w5 zz" * 120_000, "x", "x", 0, 0)]
    return out


def brute(rows, target, ngram, buckets, percent, least):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for column, texts in ((s, [r[1] for r in rows]), (t, target)):
        for x in texts:
            for b in feats(x)[1]:
                column[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text, *_ in rows:
        words, f = feats(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    open_ = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(open_[: percent * len(open_) // 100])}
    return sorted((tuple(r[:4]) + (drawn.get(id(r)),) for r in out), key=str)


@pytest.mark.parametrize(("ngram", "buckets", "percent"), [(1, 10_000, 10), (2, 50, 60), (3, 7, 100)])
def test_brute_force(spark, monkeypatch, ngram, buckets, percent):
    monkeypatch.setattr(I, "SLICE", 1 << 12)
    target = ["w1 w2 w3", None, "été " * 9]
    df, t = spark.createDataFrame(docs(), SCHEMA).repartition(5), spark.createDataFrame([(x,) for x in target], "text string")
    got = I.resample(df, t, ngram, buckets, 2024, percent, 20)
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs(), target, ngram, buckets, percent, 20)


def test_slices_keep_runs_of_words(monkeypatch):
    text = b"Aa bb  cc-dd " * 40 + b"x" * 100 + b" ee"
    whole = sorted(sum((h.tolist() for h, _ in I.features(text, 3, 1 << 30)), []))
    for size in (8, 17, 64):
        monkeypatch.setattr(I, "SLICE", size)
        assert sorted(sum((h.tolist() for h, _ in I.features(text, 3, 1 << 30)), [])) == whole


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert I.resample(none, some).count() == 0
    assert sorted(map(tuple, I.resample(some, none, least_words=0, percent=50).select("doc_id", "n_features").collect())) == [(1, 2), (2, 0)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    import __spark_entry__ as entry

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = entry.queries()["op12_importance_resampling"](spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, target, 1, 10_000, 10, 20)
