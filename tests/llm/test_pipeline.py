import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from mapstats.llm import mixing, quality_rules, secret_scan
from mapstats.llm.common import tables

from .test_ngram_join import brute as components
from .test_secret_scan import brute as secrets

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [[tuple(r) for r in df.collect()] for df in seen]
    assert all(df.columns == COLUMNS for df in seen[:5])

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM ({quality_rules.oracle_sql()}) WHERE kept").fetchall()}
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in kept)

    stay = {i for i, _, c in components([(r[0], r[1]) for r in rows[1]], P.SHINGLE_WORDS, P.PERCENT) if i == c}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if str(r[0]) in stay)
    assert 0 < len(rows[2]) < len(rows[1])

    assert sorted(r[0] for r in rows[3]) == sorted(r[0] for r in rows[2])
    scanner, before = secret_scan.scanner(), {r[0]: r for r in rows[2]}
    assert any(secrets(r[1]) for r in rows[2])
    for r in rows[3]:
        assert r[1] == secret_scan.redacted(scanner, before[r[0]][1], "[SECRET]") and not secrets(r[1]) and r[4] == len(r[1])
        if not scanner.spans(before[r[0]][1])[1]:
            assert r == before[r[0]]

    plan = mixing.plan(seen[3]).collect()
    taken = {}
    for r in rows[4]:
        taken[r[0]] = taken.get(r[0], 0) + len(r[1].encode().split())
    assert taken == {r.doc_id: r.taken for r in plan if r.taken}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in rows[4]:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    assert sorted((*r[:4], list(r[4])) for r in rows[5]) == sorted(want)


def test_tables_of_a_stage_go_when_the_next_has_other_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    before = tables()
    kept = P.quality(spark, docs, SF)
    made = tables() - before
    assert made
    late = P.near_duplicates(spark, kept, SF)  # not written between: what it reads stays
    assert made <= tables()
    late.write.parquet(str(tmp_path / "kept"))
    P.secrets(spark, spark.read.parquet(str(tmp_path / "kept")), SF)
    assert tables() <= before and not any(os.path.exists(p) for p in made)


def test_run(spark):
    assert P.run(spark, SF).count() > 0


def test_empty_and_null_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, data in enumerate(([], [(None, None, None, None, None)] * 2, [(1, "", "en", None, 0)])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        assert P.run(spark, str(tmp_path / str(k))).count() == 0


CLASHING = ["score", "key", "n", "digest", "place", "kept", "rank", "__take", "column1", "name"]


def test_extra_columns_with_clashing_names_go_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80")
    docs = docs.unionByName(docs.where("doc_id % 10 = 0")).unionByName(docs.where("doc_id = 3").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    wide = docs.selectExpr("*", *[f"concat('{c}', coalesce(doc_id, -1)) AS {c}" for c in CLASHING])
    plain, other = [docs], [wide]
    for k, (_, stage) in enumerate(P.STAGES):
        for name, chain in (("plain", plain), ("wide", other)):
            path = str(tmp_path / f"{name}{k}")
            stage(spark, chain[-1], SF).write.parquet(path)
            chain.append(spark.read.parquet(path))
        key = lambda rows: sorted(map(str, rows))
        names = COLUMNS if k < 4 else plain[-1].columns
        assert key(tuple(r) for r in plain[-1].select(names).collect()) == key(tuple(r) for r in other[-1].select(names).collect())
        if k < 4:
            assert other[-1].columns == wide.columns and plain[-1].count() > 0
            assert other[-1].where(" OR ".join(f"{c} <> concat('{c}', coalesce(doc_id, -1))" for c in CLASHING)).count() == 0
