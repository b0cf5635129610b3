import re

import duckdb
import pytest

from mapstats.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


PROSE = "the cat of the house and a dog in the yard is that which was for it with care to see, and then some other day came. "
CASES = [None, "", "one", "a b c a b c", "x y x y x y x y", "l1 a\nl1 a\n\n\nl1 a\n \n", PROSE * 4, (PROSE + "\n") * 200, "### $$$ " * 60, " ".join(f"w{i}" for i in range(80)), "漢字 é " * 30, "THE CAT!! " * 50]


def test_base_counts_and_verdict(spark):
    rows = [(i, t, lang, 1) for lang in ("en", "xx", None) for i, t in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __n long")
    got = Q.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        b = brute(CASES[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)


def test_empty_and_nulls(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert Q.quality_rules(docs).count() == 0
    docs = spark.createDataFrame([(None, None, None)], "doc_id long, text string, lang string")
    assert [r.kept for r in Q.quality_rules(docs).collect()] == [False]
    assert Q.keep(docs).columns == docs.columns
    text = " ".join(f"the {chr(97 + i % 26)}{chr(97 + i // 26)}x of" for i in range(60))
    clash = spark.createDataFrame([(1, text, "en", "a", 7), (2, "x", "en", "b", 8)], "doc_id long, text string, lang string, __words string, __kept int")
    assert [tuple(r) for r in Q.keep(clash).collect()] == [(1, text, "en", "a", 7)]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_twin(spark, sf):
    d = f"/root/testdata/{sf}"
    got = sorted(map(tuple, Q.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).collect()))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert got == sorted(duckdb.sql(Q.oracle_sql()).fetchall())
