import itertools
import random
from fractions import Fraction

import pytest

from mapstats.functions import geometry as G
from mapstats.operators import overlay as O

SCHEMA = "id long, wkb binary"


def ring(points):
    return G.closed([(float(x), float(y)) for x, y in points])


def exact_areas(shapes):
    """Areas by the set of shapes that cover them, in fractions: slabs between all crossings of all lines."""
    lines = []
    for k, parts in shapes.items():
        for r in (r for rings in parts for r in rings):
            for p, q in zip(r, r[1:]):
                if p[0] != q[0]:
                    (ax, ay), (bx, by) = sorted([tuple(map(Fraction, p)), tuple(map(Fraction, q))])
                    lines.append((k, ax, ay, bx, by))
    at = lambda s, x: s[2] + (x - s[1]) * (s[4] - s[2]) / (s[3] - s[1])
    xs = {x for s in lines for x in (s[1], s[3])}
    for s, t in itertools.combinations(lines, 2):
        a, b = max(s[1], t[1]), min(s[3], t[3])
        if a < b:
            d, e = at(s, a) - at(t, a), at(s, b) - at(t, b)
            if d * e < 0:
                xs.add(a + (b - a) * d / (d - e))
    out = {}
    for a, b in itertools.pairwise(sorted(xs)):
        here = sorted(((at(s, a) + at(s, b)) / 2, s[0]) for s in lines if s[1] <= a and s[3] >= b)
        inside = set()
        for (y, k), (z, _) in itertools.pairwise([*here, (0, None)]):
            inside ^= {k}
            if z > y and inside:
                out[frozenset(inside)] = out.get(frozenset(inside), 0) + (b - a) * (z - y)
    return out


def random_shapes(n, seed):
    """Rings of random corners, which cross themselves, some with a hole and some with a second part."""
    rng = random.Random(seed)
    some = lambda x, y, m: ring([(x + rng.randint(0, 16) / 4, y + rng.randint(0, 16) / 4) for _ in range(m)])
    out = {}
    for k in range(n):
        x, y = rng.randint(-8, 8), rng.randint(-8, 8)
        out[k] = [[some(x, y, rng.randint(3, 8)) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(1, 2))]
    return out


def table(spark, shapes):
    return spark.createDataFrame([(k, bytearray(G.wkb_multi(p))) for k, p in shapes.items()], SCHEMA)


@pytest.mark.parametrize(("seed", "size"), [(1, 2.0), (2, 0.7), (3, 50.0)])
def test_any_shapes(spark, seed, size):
    shapes = random_shapes(14, seed)
    exact = exact_areas(shapes)
    traps = O.trapezoids(table(spark, shapes), size).cache()
    got = {r.id: r.a for r in traps.groupBy("id").agg(O.area().alias("a")).collect()}
    for k in shapes:
        assert got.get(k, 0) == pytest.approx(float(sum(a for s, a in exact.items() if k in s)), abs=1e-9)
    both = {(r.a, r.b): r.s for r in O.intersections(traps, traps, size, ordered=True).groupBy("a", "b").agg(O.area().alias("s")).collect()}
    for a, b in itertools.combinations(shapes, 2):
        assert both.get((a, b), 0) == pytest.approx(float(sum(x for s, x in exact.items() if {a, b} <= s)), abs=1e-9)
    deep = {r.depth: r.s for r in O.depths(traps, size).groupBy("depth").agg(O.area().alias("s")).collect()}
    for n in range(1, 6):
        assert deep.get(n, 0) == pytest.approx(float(sum(x for s, x in exact.items() if len(s) == n)), abs=1e-9)
    traps.unpersist()


def test_groups_and_frames(spark):
    shapes = random_shapes(12, 7)
    df = table(spark, shapes)
    traps = O.trapezoids(df, 3.0).selectExpr("*", "id % 3 AS g")
    got = {r.g: (r.area_sum, r.area, r.overlapped) for r in O.cover_areas(traps, 3.0, "g").collect()}
    for g in range(3):
        exact = exact_areas({k: p for k, p in shapes.items() if k % 3 == g})
        total = lambda n: float(sum(a for s, a in exact.items() if len(s) >= n))
        assert got[g] == pytest.approx((float(sum(len(s) * a for s, a in exact.items())), total(1), total(2)))
        assert (got[g][1] < got[g][0] - 1e-9) == (got[g][2] > 1e-9)
    frames = {100: [[ring([(-2, -3), (6, -3), (2, 7)])]], 101: [[ring([(40, 40), (41, 40), (41, 42)])]]}
    cover = {r.id: (r.size, r.covered, r.overlapped, r.gap) for r in O.coverage(table(spark, frames), df, 3.0).collect()}
    exact = exact_areas(shapes | {100: frames[100]})
    inside = lambda n: float(sum(a for s, a in exact.items() if 100 in s and len(s) > n))
    assert cover[100] == pytest.approx((40, inside(1), inside(2), 40 - inside(1))) and cover[101] == pytest.approx((1, 0, 0, 1))


def test_empty(spark):
    none = O.trapezoids(spark.createDataFrame([], SCHEMA), 1.0)
    assert none.count() == 0 and O.depths(none, 1.0).count() == 0 and O.intersections(none, none, 1.0).count() == 0
    flat = spark.createDataFrame([(1, None), (2, bytearray(G.wkb_polygon([ring([(0, 0), (1, 1), (2, 2)])])))], SCHEMA)
    assert O.trapezoids(flat, 1.0).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_rebuilt_shapes_are_valid_and_as_large(seed):
    for k, parts in random_shapes(10, 100 + seed).items():
        exact = float(sum(exact_areas({k: parts}).values()))
        got = G.rebuilt(parts)
        assert sum(G.area(rings) for rings in got) == pytest.approx(exact, abs=1e-9)
        assert (G.fault(got) is None) if got else exact == 0
        assert G.parts_of(G.wkb_multi(got)) == got if got else True


SPIKE = [[ring([(0, 0), (3, 0), (3, 3), (2, 3), (2, 5), (2, 3), (0, 3)])]]


def test_faults():
    assert G.fault([[ring([(0, 0), (4, 0), (4, 4), (0, 4)])]]) is None
    assert G.fault(SPIKE) == "spike"
    assert G.fault([[ring([(0, 0), (4, 0), (4, 4), (0, 4)]), ring([(5, 5), (6, 5), (6, 6)])]]) == "hole outside its shell"
    assert G.fault([[ring([(0, 0), (9, 0), (9, 9), (0, 9)]), ring([(1, 1), (8, 1), (8, 8), (1, 8)]), ring([(2, 2), (3, 2), (3, 3)])]]) == "nested holes"
    assert G.fault([[ring([(0, 0), (4, 0), (4, 4), (0, 4)])], [ring([(1, 1), (2, 1), (2, 2)])]]) == "nested parts"
    assert G.fault([[ring([(0, 0), (4, 0), (4, 4), (0, 4)])], [ring([(3, 1), (6, 1), (6, 2)])]]) == "rings cross"
    assert G.fault([[ring([(0, 0), (float("nan"), 0), (4, 4)])]]) == "non-finite coordinate" and G.fault([[ring([(0, 0), (1, 1)])]]) == "too few points"
    island = [[ring([(0, 0), (9, 0), (9, 9), (0, 9)]), ring([(1, 1), (8, 1), (8, 8), (1, 8)])], [ring([(2, 2), (3, 2), (3, 3)])]]
    assert G.fault(island) is None and G.rebuilt(island) == sorted(G.rebuilt(G.rebuilt(island)))


def test_repairs(spark):
    bow = [[ring([(0, 0), (2, 2), (2, 0), (0, 2)])]]
    shapes = {1: [[ring([(0, 0), (1, 0), (1, 1)])]], 2: bow, 3: SPIKE, 4: bow}
    df = table(spark, shapes).unionByName(spark.createDataFrame([(5, None)], SCHEMA))
    said = lambda **k: {r.id: (r.reason, r.outcome) for r in G.repairs(df, **k).collect()}
    assert said() == {2: ("self-intersection", "refused: becomes a MultiPolygon"), 3: ("spike", "refused: moves a boundary"), 4: ("self-intersection", "refused: becomes a MultiPolygon"), 5: ("empty", "refused: empty")}
    both = ("Polygon", "MultiPolygon")
    got = said(types=both, authorised=[2, 3], most_displaced=2.0)
    assert got == {2: ("self-intersection", "repaired"), 3: ("spike", "repaired"), 4: ("self-intersection", "refused: not authorised"), 5: ("empty", "refused: not authorised")}
    row = {r.id: r for r in G.repairs(df, types=both, most_displaced=2.0).collect()}
    assert (row[2].parts, row[2].area_after, row[2].displacement) == (2, 2.0, 0.0) and row[3].area_after == 9 and row[3].displacement == 2
    assert G.fault(G.parts_of(row[2].repaired)) is None and row[5].repaired is None


def test_no_table_of_shapes_is_broadcast(spark):
    """Spark estimates shapes by the column of keys that they are made from, which is small even where they are not."""
    from mapstats.plans.catalog import QUERIES

    for name in ("j_16_overlay", "geo_04_differences", "geo_05_overlaps"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name


def test_faults_of_many_shapes_are_those_of_each(spark, monkeypatch):
    """Single rings are judged many at once, with the reasons that fault gives one by one."""
    import numpy as np

    from mapstats.plans import overlay as V

    rng = np.random.default_rng(4)
    rings = [[tuple(p) for p in rng.integers(0, 4, (n, 2)).astype(float).tolist()] for n in rng.integers(3, 7, 400)]
    rings += [[(0.0, 0.0), (float("nan"), 1.0), (1.0, 1.0)], [(0.0, 0.0), (2.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)]]
    rings += [[(x + 1e6, y + 1e6) for x, y in r] for r in rings[:50]]
    parts = [[[G.closed(r)]] for r in rings]
    want = [G.fault(p) for p in parts]
    assert len(set(want)) >= 6
    blobs = [G.wkb_multi(p) for p in parts]
    extra = [G.wkb_multi([[G.closed(r) for r in part] for part in kind]) for kind in V.KINDS]
    rows = [(k, bytearray(w)) for k, w in enumerate(blobs + extra)] + [(-1, None)]
    got = {r.id: r.fault for r in G.faults(spark.createDataFrame(rows, "id long, wkb binary")).collect()}
    assert [got[k] for k in range(len(want))] == want and got[-1] == "empty"
    assert [got[len(want) + k] for k in range(len(extra))] == [G.fault(G.parts_of(w)) for w in extra]
    monkeypatch.setattr(G, "fault", lambda _: pytest.fail("rings were judged one by one"))
    for at, p in G.single_rings(blobs):
        assert G.ring_faults(p) == [want[k] for k in at.tolist()]
