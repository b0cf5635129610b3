import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mapstats.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " ", "\n\n  x", "The quick brown fox's 123 jumps!!", "naïve café 漢字 🙂🙂", "=" * 3000, "ab" * 2000, "x<|endoftext|>y<|endoftext|>", "  z \t\n", "don't WE'LL 'tis", " " * 500 + "end", "0123456789" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.tables(bpe._vocabulary(PATH))


def _random_texts(n):
    r = random.Random(5)
    pool = "aeiouthnsrd AEQZ .,!?'\n\t0123éüß漢🙂-_=/+"
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 300))) for _ in range(n)]


def test_encoder_equals_library(own, library):
    for t in TEXTS + _random_texts(400):
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_merges_equal_encoder(own):
    for t in TEXTS + _random_texts(200):
        for piece in own._pre.findall(t):
            assert own.merge(piece.encode()) == own.encode_piece(piece.encode())


def test_whole_tokens_are_proved(own, library):
    r = random.Random(1)
    for s in r.sample(sorted(own.whole), 500):
        assert own.merge(s.encode()) == [own.ids[s.encode()]]
    assert len(own.whole) > 40_000


def test_parts_equal_library(own, library, monkeypatch):
    """Texts cut at spaces and lines, with remembered parts, a small memory, and as pieces of a long text."""
    texts = TEXTS + _random_texts(300) + ["a\n\n\nb c", "\nx", "x\n", "a \n b", "a\u00a0 b", "\u3000c d\n", "it's  two", "end.\r\nnext", "d'accord l'été, fin.", "a\x1cb \x1c c", "x" * 200 + " y" * 50]
    for cache, piece in ((250_000, 1_000_000), (7, 1_000_000), (50, 40)):
        monkeypatch.setattr(bpe, "CACHE", cache)
        monkeypatch.setattr(bpe, "PIECES", cache)
        monkeypatch.setattr(bpe, "PIECE", piece)
        counts, codes = bpe.counted(own), bpe.coded(own)
        for t in texts:
            want = library.encode(t, add_special_tokens=False).ids
            assert sum(counts.of(t)) == len(want), t[:80]
            got = np.frombuffer(b"".join(codes.of(t)), dtype="<u4")
            assert got.tolist() == want, t[:80]
            assert own.decoded(got) == t.encode()


def test_merges_of_long_pieces(own, monkeypatch):
    """The heap, for long pieces, and the list, for short ones, do the same."""
    pieces = [p.encode() for t in TEXTS + _random_texts(100) for p in own._pre.findall(t)]
    short = [own.merge(p) for p in pieces if len(p) <= bpe.LONGEST]
    monkeypatch.setattr(bpe, "LONGEST", 0)
    assert short == [own.merge(p) for p in pieces if len(p) <= 64]


def test_round_trip(own):
    for t in TEXTS + _random_texts(100):
        assert own.decode(np.array(own.encode(t), dtype="<u4")) == t


def test_frames(spark, library):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS + _random_texts(50))] + [(None, None, "k"), (3, "twice", "k"), (3, "twice", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = bpe.token_counts(docs, PATH, 20).collect()
    expect = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counted) == expect
    assert all(r.over_limit == (r.n_tokens > 20) for r in counted)
    coded = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs, PATH).collect()}
    for i, t, _ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert (i, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in coded


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.token_counts(docs, PATH).count() == 0
    assert bpe.encode(docs, PATH, with_ids=True).count() == 0
