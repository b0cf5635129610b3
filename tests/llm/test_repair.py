import functools
import hashlib
import re
import zlib

import numpy as np
import pytest

from mapstats.llm import repair as R
from mapstats.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, live string, seen string, k string, piece string"
GAP = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for c, turn, role, text, *_ in rows:
        own = out.setdefault(c, [])
        c, key = " " if c is None else c, " " if turn is None else turn
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{c}:{key}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(own):
    """Counts and the cheapest edits by trying them all, from the end, with whole audits compared as strings."""
    own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in own:
        bare = text.rstrip(GAP)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(k, state, inserted):
        found = []
        if k == len(own):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            cost, audit, left = best(k + 1, state, 0)
            found.append((cost + 3, "D" + audit, left))
            if faults[k] not in ("b", "d"):
                for letter, price, role in [("K", 0, own[k][1])] + [("R", 2, r) for r in ("user", "assistant")]:
                    if to := after.get((state, role[:1])):
                        cost, audit, left = best(k + 1, to, 0)
                        found.append((cost + price + (faults[k] == "t"), letter + audit, (f"{role}:{own[k][2]}", *left)))
        if inserted < 4:
            for role in ("user", "assistant"):
                if to := after.get((state, role[0])):
                    cost, audit, left = best(k, to, inserted + 1)
                    found.append((cost + 2, "I" + audit, (f"{role}:", *left)))
        return min(found, default=(10**9, "", ()))

    cost, audit, left = best(0, "", 0)
    known = {t for t, *_ in own if t is not None}
    pairs = zip(own, own[1:])
    return (max(known) - min(known) + 1 - len(known) if known else 0, *[faults.count(f) for f in "bdt"], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def rows(n=150, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        for k in range(int(rng.integers(0, 14))):
            role = ("system", "user", "assistant", "assistant", "user", "tool", "", None)[rng.integers(0, 8)] if c % 3 else ("user", "assistant")[k % 2]
            text = ("Yes.", "no", "", None, " \t\n", "Why? ", "a!\n", "été.", "x" * int(rng.integers(1, 99)))[rng.integers(0, 9)]
            out.append((c, int(k + rng.integers(0, 2)) if rng.random() > 0.1 else None, role, text))
    out += [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (900, None, "user", "."), (901, 5, "user", "w " * 500_000)]
    out += [(902, k, "user", "same.") for k in range(30)]
    return [(*r, "x", "x", "x", "x") for r in out]


@pytest.mark.parametrize("limit", [512, 4, 1])
def test_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(turns, "ROWS", limit)
    given = rows()
    got = R.repair(R.damage(spark.createDataFrame(given, SCHEMA))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {c: brute(own) for c, own in damaged(given).items()} and len(got) == len({r[0] for r in given})


def test_undamaged_and_empty(spark):
    some = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "cut off")]
    got = {r[0]: tuple(r)[1:] for r in R.repair(spark.createDataFrame(some, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: brute([r[1:] for r in some[:2]]), 2: brute([r[1:] for r in some[2:]])} and got[1][6] == "KK"
    assert R.repair(R.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_long_conversations_in_one_tensor():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 100):
        own = [(k, ("user", "assistant", "system", "x")[rng.integers(0, 4)], ("a.", "b", f"{k}?")[rng.integers(0, 3)]) for k in range(n)]
        codes, cut = [{"u": 1, "a": 2, "s": 0}.get(r[1][0], 3) for r in own], []
        seen = set()
        gone = [(r[1:] in seen) or seen.add(r[1:]) is not None for r in own]
        cut = [r[2][-1] not in ".?" and not g for r, g in zip(own, gone)]
        b = R.Bucket([n], [codes], [gone], [cut])
        edits, _, _ = b.trace(b.backward(), np.zeros(1, dtype=np.int64))
        assert bytes(R.LETTERS[e] for e in edits[:, 0]).decode() == brute(own)[6]


def test_whole_table(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op13_conversation_repair"](spark, sf).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {c: brute(own) for c, own in damaged(given).items()}
