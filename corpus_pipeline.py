"""A corpus pipeline of text operators: quality, near duplicates, secrets, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mapstats.llm import bpe, mixing, ngram_join, quality_rules, secret_scan
from mapstats.llm.common import release, table, tables, written

SHINGLE_WORDS = 5
PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_past: set[str] = set()  # tables of the stages before


def staged(f: Stage) -> Stage:
    """A stage that begins by removing the tables of those before it, as their results have been written and read
    again by then; tables that its documents still read stay."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _past:
            read = "".join(docs.inputFiles())
            gone = {p for p in _past if p.rsplit("/", 1)[1] not in read}
            release(gone)
            _past.difference_update(gone)
        before = tables()
        out = f(spark, docs, sf_dir)
        _past.update(tables() - before)
        return out

    return run


@staged
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; repeated rows pass or fail together."""
    return quality_rules.keep(docs)


@staged
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id, with all rows of that id; rows without an id stay."""
    return ngram_join.keep_one(docs, SHINGLE_WORDS, PERCENT)


@staged
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs)


@staged
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources; repeats are rows of their own."""
    return mixing.mixed(docs)


@staged
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digest of the tokens, digest of the decoded text, and the tokens themselves."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoding),
]
#: Components of near copies, Markov models, hashed blocks and BPE are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
