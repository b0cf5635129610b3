import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest

from mapstats.operators import components as K
from mapstats.operators import graph as G
from mapstats.operators import partition as P


def entropy(labels, weights):
    mass = Counter()
    for x, w in zip(labels, weights, strict=True):
        mass[x] += w
    total = sum(mass.values())
    return -sum(m / total * math.log2(m / total) for m in mass.values() if m)


def distance(a, b, weights):
    return 2 * entropy(list(zip(a, b, strict=True)), weights) - entropy(a, weights) - entropy(b, weights)


def random_plans(seed, plans, nodes, labels):
    rng = np.random.default_rng(seed)
    return rng.integers(1, labels + 1, (plans, nodes)), rng.integers(0, 90, nodes)


@pytest.mark.parametrize(("seed", "nodes", "labels"), [(1, 40, 3), (2, 200, 9), (3, 7, 7)])
def test_variation_of_information_of_random_plans(spark, seed, nodes, labels):
    (a, b), people = random_plans(seed, 2, nodes, labels)
    rows = spark.createDataFrame([("k", int(x), int(y), int(p)) for x, y, p in zip(a, b, people)], "k string, x int, y int, totpop long")
    r = P.variation_of_information(rows, "k").first()
    assert r.unit_vi == pytest.approx(distance(a, b, [1] * nodes), abs=1e-7) and r.pop_vi == pytest.approx(distance(a, b, people.tolist()), abs=1e-7)
    renamed = spark.createDataFrame([("k", int(x), 100 - int(x), int(p)) for x, p in zip(a, people)], "k string, x int, y int, totpop long")
    assert tuple(P.variation_of_information(renamed, "k").first())[1:] == (0, 0)


@pytest.mark.parametrize(("tile", "chunk"), [(32, 1 << 14), (3, 16), (1, 7)])
def test_tiles_give_the_distances_of_all_pairs(spark, monkeypatch, tile, chunk):
    monkeypatch.setattr(P, "TILE", tile)
    monkeypatch.setattr(P, "CHUNK", chunk)
    plans, people = random_plans(6, 8, 50, 5)
    key = [(k % 3, 100 * (k // 3) + 99) for k in range(8)]
    rows = [(s, t, n, int(d), int(people[n])) for (s, t), plan in zip(key, plans) for n, d in enumerate(plan)]
    assign = spark.createDataFrame(rows, "seed int, step long, node long, district int, totpop long")
    saved = spark.createDataFrame(key, "seed int, step long")
    starts = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "seed int, start string")
    got = {(r.i, r.j): r for r in P.all_pairs(assign, saved, starts, 5, 150).collect()}
    order = sorted(range(8), key=lambda k: key[k])
    assert len(got) == 28
    for (i, a), (j, b) in itertools.combinations(enumerate(order, 1), 2):
        r = got[i, j]
        assert r.unit_vi == pytest.approx(distance(plans[a], plans[b], [1] * 50), abs=1e-9)
        assert r.pop_vi == pytest.approx(distance(plans[a], plans[b], people.tolist()), abs=1e-9)
        assert r.same_chain == (key[a][0] == key[b][0]) and r.same_start == ((key[a][0] == 2) == (key[b][0] == 2))
        assert r.lag == abs(key[a][1] - key[b][1]) and r.post_warmup == (min(key[a][1], key[b][1]) >= 150)


def test_maximin(spark):
    plans, people = random_plans(9, 9, 30, 4)
    far = {(i, j): distance(plans[i], plans[j], people.tolist()) for i, j in itertools.permutations(range(9), 2)}
    want = [4]
    while len(want) < 6:
        want.append(max((i for i in range(9) if i not in want), key=lambda i: (min(far[i, c] for c in want), -i)))
    pairs = spark.createDataFrame([(i, j, d) for (i, j), d in far.items() if i < j], "i long, j long, pop_vi double")
    assert [r.i for r in P.maximin(pairs, 6, 4).orderBy("rank").collect()] == want
    assert P.maximin(pairs, 50, 0).count() == 9
    with pytest.raises(ValueError):
        P.maximin(spark.createDataFrame([(0, 1, 0.0)], "i long, j long, pop_vi double"), 2, 0)


def test_fingerprint_ignores_labels(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    plans = spark.createDataFrame([(p, n, d) for p, ds in {"a": [1, 1, 2, 2], "b": [7, 7, 9, 9], "c": [1, 2, 2, 2]}.items() for n, d in enumerate(ds)], "plan string, node long, district int")
    got = {r["plan"]: r["plan_hash"] for r in P.fingerprint(P.cut_edges(edges, plans, "plan"), "plan").collect()}
    assert got["a"] == got["b"] != got["c"] and got["a"] == hashlib.sha256(b"1:2").hexdigest()


def test_matching_and_fields():
    r = np.random.default_rng(1)
    for n in (3, 5):
        w = r.integers(0, 50, (n, n)).astype(float)
        assert P.best_matching(w) == max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
    assert P.election_fields(["G20USSDABC", "G20USSRXYZ", "NAME"]) == {"USS": ("G20USSDABC", "G20USSRXYZ")}
    with pytest.raises(ValueError):
        P.election_fields(["G20USSDABC", "G20USSDDEF", "G20USSRXYZ"])


def lattice(wide, high):
    at = lambda x, y: y * wide + x
    return np.array([(at(x, y), at(x + 1, y)) for y in range(high) for x in range(wide - 1)] + [(at(x, y), at(x, y + 1)) for y in range(high - 1) for x in range(wide)])


@pytest.mark.parametrize("seed", [3, 8, 21])
def test_starts_are_balanced_and_repeat(seed):
    weight = 5 + np.arange(30) % 4
    a, b = (G.Chain(weight, lattice(6, 5), 3, 0.12, seed) for _ in range(2))
    a.start()
    b.start()
    people = np.bincount(a.district, weights=weight)[1:]
    assert (abs(people / people.mean() - 1) <= 0.12).all() and len(people) == 3 and (a.district == b.district).all() and a.contiguous()


def test_resumed_chain_goes_on_as_the_whole_one():
    wide, high = 8, 5
    votes = np.random.default_rng(4).integers(1, 60, (2, wide * high))
    columns = np.arange(wide * high) % wide // 2 + 1

    def chain():
        c = G.Chain(np.full(wide * high, 7), lattice(wide, high), 4, 0.15, 5)
        c.district = columns.astype(np.int64)
        return c

    def run(c, n):
        out = []
        for _ in range(n):
            c.step()
            out.append(c.record(*votes))
            assert c.contiguous() and out[-1]["max_abs_pop_dev"] <= 0.15
        return out

    whole, first, later = run(chain(), 45), chain(), chain()
    head = run(first, 31)
    later.load(first.save())
    assert whole == head + run(later, 14) and len({r["plan_hash"] for r in whole}) > 3


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    edges, rows, want = set(), [], {}
    for a, b in rng.integers(0, 60, (90, 2)).tolist() + [(k, k + 1) for k in range(100, 160)]:
        edges.add((min(a, b), max(a, b)))
    for plan in "pq":
        district = {n: int(rng.integers(1, 4)) for n in range(60)} | {n: 1 for n in range(100, 161)}
        rows += [(plan, n, d) for n, d in district.items()]
        root = {n: n for n in district}
        for _ in district:
            for a, b in edges:
                if district[a] == district[b]:
                    root[a] = root[b] = min(root[a], root[b])
        for d in (1, 2, 3):
            own = [n for n in district if district[n] == d]
            want[plan, d] = (len(own), len({root[n] for n in own}))
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = {(r.plan, r.district): (r.units, r.components) for r in K.district_components(e, spark.createDataFrame(rows, "plan string, node long, district int"), "plan").collect()}
    assert got == want


def test_spanning_forest_is_that_of_edges_taken_one_by_one():
    rng = np.random.default_rng(11)
    for n, m in ((1, 0), (2, 1), (30, 20), (200, 900)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        up, want = list(range(n)), []
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = next(r for r in range(n) if up[x] == up[r]), next(r for r in range(n) if up[y] == up[r])
            if up[x] != up[y]:
                want.append(k)
                up = [up[y] if u == up[x] else u for u in up]
        assert G.spanning(n, a, b).tolist() == want
