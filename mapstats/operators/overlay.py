"""Overlay of polygons as joins and windows: trapezoids of shapes, their intersections, and depths of cover.

A shape is cut into vertical slabs between neighbouring x of its vertices and self-crossings. In a slab its segments
do not cross, and by the even-odd rule the stretches between the first and second, third and fourth of them are
inside: trapezoids with vertical sides. So rings of any form are understood: concave ones, holes, several parts, and
also rings that cross themselves. Two trapezoids meet in trapezoids again, by a closed form. Many that lie over one another
are cut into slabs anew, cell by cell of a grid, and a running sum over their lower and upper sides gives how many cover
each piece.

Everything but the reading of WKB is Spark expressions. `size` is the width of strips and cells: work in one of them
grows with the square of what lies in it, so it should hold tens of segments. Results do not depend on it.
Joins are asked to merge: Spark would estimate the rows of shapes by the compressed column of keys that they are made from, and broadcast them all.
Shapes without area, and null or empty ones, have no trapezoids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapstats.functions import geometry as G

SIDES = ("x0", "x1", "b0", "b1", "t0", "t1")  # from x0 to x1; lower and upper side at both


def segments(shapes: DataFrame, key: str = "id") -> DataFrame:
    """key, n, ax, ay, bx, by of all rings, from left to right; vertical ones bound no slab and are left out."""
    kind = dict(shapes.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for k, wkb in zip(batch.column(key).to_pylist(), batch.column("wkb").to_pylist(), strict=True):
                rings = [r for part in G.parts_of(wkb) for r in part] if wkb else []
                n = 0
                for r in rings:
                    for p, q in zip(G.closed(r), G.closed(r)[1:], strict=False):
                        if p[0] != q[0]:
                            (ax, ay), (bx, by) = (p, q) if p[0] < q[0] else (q, p)
                            for col, value in zip(cols, (k, n, ax, ay, bx, by), strict=True):
                                col.append(value)
                            n += 1
            types = [batch.column(key).type, pa.int64()] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "n", "ax", "ay", "bx", "by"])

    return shapes.select(key, "wkb").mapInArrow(run, f"{key} {kind}, n long, ax double, ay double, bx double, by double")


def _on(x: Column, s: str = "") -> Column:
    """y of a segment at x."""
    ax, ay, bx, by = (F.col(s + c) for c in ("ax", "ay", "bx", "by"))
    return F.when(x == bx, by).otherwise(ay + (x - ax) * ((by - ay) / (bx - ax)))


def _span(low: Column, high: Column, size: float) -> Column:
    """Numbers of the strips that an open interval meets."""
    first = F.floor(low / size)
    return F.sequence(first, F.greatest(first, F.ceil(high / size) - 1))


def _slabs(cuts: DataFrame, *by: str) -> DataFrame:
    """Neighbouring x as x0 and x1."""
    along = Window.partitionBy(*by).orderBy("x")
    return cuts.distinct().withColumn("x1", F.lead("x").over(along)).where("x1 IS NOT NULL").withColumnRenamed("x", "x0")


def trapezoids(shapes: DataFrame, size: float, key: str = "id") -> DataFrame:
    """key and SIDES of the trapezoids that shapes consist of by the even-odd rule."""
    s = segments(shapes, key).withColumn("strip", F.explode(_span(F.col("ax"), F.col("bx"), size)))
    s = s.withColumns({"lx": F.greatest("ax", F.col("strip") * size), "rx": F.least("bx", (F.col("strip") + 1) * size)}).where("lx < rx")
    other = s.select(key, "strip", *[F.col(c).alias(f"o_{c}") for c in ("n", "ax", "ay", "bx", "by", "lx", "rx")])
    left, right = F.greatest("lx", "o_lx"), F.least("rx", "o_rx")
    flat = (F.least("ay", "by") <= F.greatest("o_ay", "o_by")) & (F.least("o_ay", "o_by") <= F.greatest("ay", "by"))
    met = s.join(other.hint("merge"), [key, "strip"]).where((F.col("n") < F.col("o_n")) & (left < right) & flat)
    met = met.select(key, "strip", left.alias("l"), right.alias("r"), (_on(left) - _on(left, "o_")).alias("d0"), (_on(right) - _on(right, "o_")).alias("d1"))
    met = met.where("d0 * d1 < 0").select(key, "strip", (F.col("l") + (F.col("r") - F.col("l")) * (F.col("d0") / (F.col("d0") - F.col("d1")))).alias("x"))
    cuts = s.select(key, "strip", F.explode(F.array("lx", "rx")).alias("x")).unionByName(met)
    slab = _slabs(cuts, key, "strip")
    lines = s.join(slab.hint("merge"), [key, "strip"]).where("lx <= x0 AND rx >= x1").select(key, "strip", "x0", "x1", "n", _on(F.col("x0")).alias("y0"), _on(F.col("x1")).alias("y1"))
    up = Window.partitionBy(key, "strip", "x0").orderBy(F.col("y0") + F.col("y1"), "n")
    lines = lines.withColumns({"place": F.row_number().over(up), "t0": F.lead("y0").over(up), "t1": F.lead("y1").over(up)})
    inside = lines.where("place % 2 = 1 AND (t0 > y0 OR t1 > y1)")
    return inside.select(key, "x0", "x1", F.col("y0").alias("b0"), F.col("y1").alias("b1"), "t0", "t1")


def _meet(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Trapezoids in which those of a row, with columns a_x0 ... and p_x0 ..., meet."""
    left, right = F.greatest("a_x0", "p_x0"), F.least("a_x1", "p_x1")

    def at(s: str, side: str, x: Column) -> Column:
        x0, x1, y0, y1 = F.col(f"{s}_x0"), F.col(f"{s}_x1"), F.col(f"{s}_{side}0"), F.col(f"{s}_{side}1")
        return F.when(x == x1, y1).otherwise(y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))

    ends = {f"{s}{side}{k}": at(s, side, x) for s in "ap" for side in "bt" for k, x in ((0, left), (1, right))}
    df = pairs.where(left < right).select(*keep, left.alias("l"), right.alias("r"), *[c.alias(n) for n, c in ends.items()])

    def crossing(f: str, g: str) -> Column:
        d0, d1 = F.col(f"{f}0") - F.col(f"{g}0"), F.col(f"{f}1") - F.col(f"{g}1")
        return F.when(d0 * d1 < 0, d0 / (d0 - d1))

    found = F.array(F.lit(0.0), *[crossing(f, g) for f, g in (("at", "pt"), ("ab", "pb"), ("at", "pb"), ("pt", "ab"))], F.lit(1.0))
    df = df.withColumn("cuts", F.array_sort(F.array_distinct(F.filter(found, lambda c: c.isNotNull()))))
    df = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("cuts") - 1)))
    df = df.withColumns({"u": F.element_at("cuts", F.col("k")), "v": F.element_at("cuts", F.col("k") + 1)})
    line = lambda n, w: F.when(w == 1, F.col(f"{n}1")).otherwise(F.col(f"{n}0") + w * (F.col(f"{n}1") - F.col(f"{n}0")))
    x = lambda w: F.when(w == 1, F.col("r")).otherwise(F.col("l") + w * (F.col("r") - F.col("l")))
    low = lambda w: F.greatest(line("ab", w), line("pb", w))
    high = lambda w: F.least(line("at", w), line("pt", w))
    u, v, mid = F.col("u"), F.col("v"), (F.col("u") + F.col("v")) / 2
    df = df.where(high(mid) > low(mid)).select(*keep, x(u).alias("x0"), x(v).alias("x1"), low(u).alias("b0"), low(v).alias("b1"), F.greatest(high(u), low(u)).alias("t0"), F.greatest(high(v), low(v)).alias("t1"))
    return df.where("x0 < x1")


def _gridded(traps: DataFrame, size: float) -> DataFrame:
    """A row for each cell that the box of a trapezoid meets, with the first of them."""
    low, high = F.least("b0", "b1"), F.greatest("t0", "t1")
    first = {"cx0": F.floor(F.col("x0") / size), "cy0": F.floor(low / size)}
    df = traps.withColumns(first | {"low": low, "high": high}).withColumn("cx", F.explode(_span(F.col("x0"), F.col("x1"), size)))
    return df.withColumn("cy", F.explode(_span(F.col("low"), F.col("high"), size)))


def intersections(a: DataFrame, b: DataFrame, size: float, a_key: str = "id", b_key: str = "id", ordered: bool = False) -> DataFrame:
    """a, b and SIDES of the trapezoids in which those of a meet those of b; with `ordered` only pairs a < b. An equi-join
    on grid cells finds each pair in the first cell that both meet."""
    ga, gb = (_gridded(df.select(F.col(k).alias("key"), *SIDES), size) for df, k in ((a, a_key), (b, b_key)))
    names = ("key", *SIDES, "cx0", "cy0", "low", "high")
    ga, gb = (g.select("cx", "cy", *[F.col(c).alias(f"{s}_{c}") for c in names]) for s, g in (("a", ga), ("p", gb)))
    once = (F.col("cx") == F.greatest("a_cx0", "p_cx0")) & (F.col("cy") == F.greatest("a_cy0", "p_cy0"))
    boxes = (F.col("a_x0") < F.col("p_x1")) & (F.col("p_x0") < F.col("a_x1")) & (F.col("a_low") < F.col("p_high")) & (F.col("p_low") < F.col("a_high"))
    pairs = ga.join(gb.hint("merge"), ["cx", "cy"]).where(once & boxes)
    pairs = pairs.where("a_key < p_key") if ordered else pairs
    return _meet(pairs.withColumns({"a": F.col("a_key"), "b": F.col("p_key")}), ["a", "b"])


def _piece() -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("t0") - F.col("b0") + F.col("t1") - F.col("b1")) / 2


def area() -> Column:
    """Total of the areas of trapezoids."""
    return F.sum(_piece())


def area_where(condition: Column) -> Column:
    return F.sum(F.when(condition, _piece()))


def depths(traps: DataFrame, size: float, *group: str) -> DataFrame:
    """group, SIDES, depth: pieces that do not overlap, and by how many trapezoids of their group each is covered.
    Pieces of a cell come from what lies in it alone; cells lie side by side."""
    cell = [*group, "cx", "cy"]
    cut = _gridded(traps.select(*group, *SIDES), size).select(*cell, *[F.col(c).alias(f"a_{c}") for c in SIDES])
    box = {"x0": "cx", "x1": "cx + 1", "b0": "cy", "b1": "cy", "t0": "cy + 1", "t1": "cy + 1"}
    cut = _meet(cut.withColumns({f"p_{c}": F.expr(e) * F.lit(float(size)) for c, e in box.items()}), cell)
    line = cut.select(*cell, "x0", "x1", F.explode(F.array(F.struct(F.col("b0").alias("y0"), F.col("b1").alias("y1"), F.lit(1).alias("step")), F.struct(F.col("t0").alias("y0"), F.col("t1").alias("y1"), F.lit(-1).alias("step")))).alias("e")).select(*cell, F.col("x0").alias("ax"), F.col("x1").alias("bx"), F.col("e.y0").alias("ay"), F.col("e.y1").alias("by"), "e.step")
    other = line.select(*cell, *[F.col(c).alias(f"o_{c}") for c in ("ax", "ay", "bx", "by")]).distinct()
    left, right = F.greatest("ax", "o_ax"), F.least("bx", "o_bx")
    met = line.drop("step").distinct().join(other.hint("merge"), cell).where((left < right) & (F.least("ay", "by") < F.greatest("o_ay", "o_by")) & (F.least("o_ay", "o_by") < F.greatest("ay", "by")))
    met = met.select(*cell, left.alias("l"), right.alias("r"), (_on(left) - _on(left, "o_")).alias("d0"), (_on(right) - _on(right, "o_")).alias("d1"))
    met = met.where("d0 * d1 < 0").select(*cell, (F.col("l") + (F.col("r") - F.col("l")) * (F.col("d0") / (F.col("d0") - F.col("d1")))).alias("x"))
    slab = _slabs(line.select(*cell, F.explode(F.array("ax", "bx")).alias("x")).unionByName(met), *cell)
    events = line.join(slab.hint("merge"), cell).where("ax <= x0 AND bx >= x1").select(*cell, "x0", "x1", _on(F.col("x0")).alias("b0"), _on(F.col("x1")).alias("b1"), "step")
    up = Window.partitionBy(*cell, "x0").orderBy(F.col("b0") + F.col("b1"), F.desc("step"))
    pieces = events.withColumns({"depth": F.sum("step").over(up.rowsBetween(Window.unboundedPreceding, 0)), "t0": F.lead("b0").over(up), "t1": F.lead("b1").over(up)})
    return pieces.where("depth > 0 AND (t0 > b0 OR t1 > b1)").select(*group, *SIDES, "depth")


def cover_areas(traps: DataFrame, size: float, *group: str) -> DataFrame:
    """group, area_sum (of all that covers), area (of the union), overlapped (area under two or more)."""
    part = lambda n: F.coalesce(area_where(F.col("depth") >= n), F.lit(0.0))
    return depths(traps, size, *group).groupBy(*group).agg(F.sum(F.col("depth") * _piece()).alias("area_sum"), part(1).alias("area"), part(2).alias("overlapped"))


def coverage(frames: DataFrame, shapes: DataFrame, size: float, frame: str = "id", key: str = "id") -> DataFrame:
    """frame, size, covered (by the union of shapes), overlapped (by two or more), gap."""
    f = trapezoids(frames, size, frame)
    inside = intersections(f, trapezoids(shapes, size, key), size, frame, key)
    d = depths(inside, size, "a").groupBy(F.col("a").alias(frame)).agg(area_where(F.col("depth") >= 1).alias("covered"), area_where(F.col("depth") >= 2).alias("overlapped"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = f.groupBy(frame).agg(area().alias("size")).join(d, frame, "left")
    return out.select(frame, "size", zero(F.col("covered")).alias("covered"), zero(F.col("overlapped")).alias("overlapped"), (F.col("size") - zero(F.col("covered"))).alias("gap"))
