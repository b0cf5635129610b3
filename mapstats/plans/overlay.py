"""Queries of polygons of any form: overlay, union, coverage, overlaps, validity and repair.

Each unit has a shape in its cell of the grid, of one of nine kinds: among them concave, holed and double ones, some
that reach into the next cell, and three that are invalid. The SQL twins count points of a raster that is fine
enough to be exact for them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapstats.functions import geometry as G
from mapstats.operators import overlay as O
from mapstats.session import spread
from mapstats.sources.views import WIDTH

from .registry import query

SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]
box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
#: Shapes by kind, which is node % 9, as lists of polygons, which are lists of rings.
KINDS: list[list[list[list[tuple]]]] = [
    [[SQUARE]],
    [[[(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]]],
    [[SQUARE, box(0.25, 0.25, 0.75, 0.75)]],
    [[box(0, 0, 0.25, 1)], [box(0.75, 0, 1, 1)]],
    [[box(0, 0, 1.5, 1)]],
    [[[(0, 0), (1, 0), (0, 1)]]],
    [[[(0, 0), (1, 1), (1, 0), (0, 1)]]],
    [[[(0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 1.25), (0.5, 1), (0, 1)]]],
    [[SQUARE, box(0.25, 0.25, 0.5, 0.75), box(0.25, 0.5, 0.75, 0.75)]],
]
STRIP = 5.0
CELL = 2.0

#: v_points: 64 points of each cell, as (gx, gy, q), with the unit whose shape they lie in. A point stands for a triangle.
RASTER = f"""
w_local AS (SELECT i, j, q, i / 4.0 + 0.125 + CASE q WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 0 END / 12.0 AS x, j / 4.0 + 0.125 + CASE q WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END / 12.0 AS y
  FROM range(4) a(i), range(4) b(j), range(4) c(q)),
v_points AS (
  SELECT node, (node % {WIDTH}) * 4 + i + shift AS gx, (node // {WIDTH}) * 4 + j AS gy, q FROM v_units, w_local, (VALUES (0), (4)) AS s(shift)
  WHERE CASE WHEN shift = 4 THEN node % 9 = 4 AND x < 0.5 ELSE CASE node % 9
    WHEN 1 THEN NOT (x > 0.5 AND y > 0.5) WHEN 2 THEN NOT (x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.25 AND 0.75) WHEN 3 THEN x < 0.25 OR x > 0.75
    WHEN 5 THEN x + y < 1 WHEN 6 THEN x > greatest(y, 1 - y) OR x < least(y, 1 - y)
    WHEN 8 THEN (x BETWEEN 0.25 AND 0.5 AND y BETWEEN 0.25 AND 0.75) = (x BETWEEN 0.25 AND 0.75 AND y BETWEEN 0.5 AND 0.75) ELSE TRUE END END)"""


def raster(sql: str) -> str:
    return f"WITH {RASTER}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"WITH {RASTER} {sql.strip()}"


def shapes(v) -> DataFrame:
    """id and wkb of each unit's shape."""

    def build(batches):
        for pdf in batches:
            node = pdf["id"].to_numpy()
            out = np.empty(len(node), dtype=object)
            for kind, parts in enumerate(KINDS):
                at = np.flatnonzero(node % len(KINDS) == kind)
                if not len(at):
                    continue
                corner = np.stack([node[at] % WIDTH, node[at] // WIDTH], 1).astype("<f8")[:, None]
                form = G.wkb_multi([[G.closed(ring) for ring in rings] for rings in parts])
                blobs = np.tile(np.frombuffer(form, dtype=np.uint8), (len(at), 1))
                for first, points in G.places(form):
                    blobs[:, first : first + 16 * len(points)] = (points + corner).astype("<f8").reshape(len(at), -1).view(np.uint8)
                out[at] = [b.tobytes() for b in blobs]
            pdf["wkb"] = out
            yield pdf

    return spread(v.table("customer").select(F.col("c_custkey").alias("id")), "id").mapInPandas(build, "id long, wkb binary")


def strips(v) -> DataFrame:
    """Six strips of five columns; the last lies beyond the grid, where some shapes reach."""

    def build(batches):
        for pdf in batches:
            top = [float(n // WIDTH + 1) for n in pdf["n"]]
            pdf["wkb"] = [G.wkb_polygon([G.closed(box(k * STRIP, 0.0, (k + 1) * STRIP, t))]) for k, t in zip(pdf["id"], top, strict=True)]
            yield pdf[["id", "wkb"]]

    n = v.units.agg(F.max("node").alias("n"))
    return n.withColumn("id", F.explode(F.array(*[F.lit(k).cast("long") for k in range(6)]))).mapInPandas(build, "id long, wkb binary")


@query("j_16_overlay", raster("SELECT node AS unit, gx // 20 AS strip, count(*) / 64.0::DOUBLE AS area FROM v_points GROUP BY 1, 2"))
def j_16(v):
    pieces = O.intersections(O.trapezoids(shapes(v), CELL), O.trapezoids(strips(v), CELL), CELL)
    return pieces.groupBy(F.col("a").alias("unit"), F.col("b").alias("strip")).agg(F.round(O.area(), 9).alias("area")).where("area > 0")


@query(
    "geo_03_union",
    raster("""SELECT plan, district, count(*) / 64.0::DOUBLE AS area_sum, count(DISTINCT (gx, gy, q)) / 64.0::DOUBLE AS area,
    (SELECT count(*) FROM (SELECT 1 FROM v_points JOIN v_plans b USING (node) WHERE b.plan = a.plan AND b.district = a.district GROUP BY gx, gy, q HAVING count(*) > 1)) / 64.0::DOUBLE AS overlapped
    FROM v_points JOIN v_plans a USING (node) GROUP BY plan, district"""),
)
def geo_03(v):
    """Area of the union of a district's shapes, beside the sum of their areas, and what lies under two or more."""
    traps = O.trapezoids(shapes(v), CELL).join(v.plans.withColumnRenamed("node", "id"), "id")
    u = O.cover_areas(traps, CELL, "plan", "district")
    return u.select("plan", "district", *[F.round(c, 9).alias(c) for c in ("area_sum", "area", "overlapped")])


@query(
    "geo_04_coverage",
    raster("""WITH c AS (SELECT gx // 20 AS strip, gx, gy, q, count(*) AS n FROM v_points GROUP BY 1, 2, 3, 4),
    t AS (SELECT unnest(range(6)) AS strip, (SELECT max(node) // 25 + 1 FROM v_units) * 5.0::DOUBLE AS size)
    SELECT t.strip, t.size, count(n) / 64.0::DOUBLE AS covered, count(n) FILTER (n > 1) / 64.0::DOUBLE AS overlapped, t.size - count(n) / 64.0::DOUBLE AS gap, t.size - count(n) / 64.0::DOUBLE <= greatest(1e-3, 1e-6 * t.size) AS within_tolerance
    FROM t LEFT JOIN c USING (strip) GROUP BY 1, 2"""),
)
def geo_04(v):
    """What of each strip is covered, covered twice, and left open."""
    c = O.coverage(strips(v), shapes(v), CELL)
    within = F.col("gap") <= F.greatest(F.lit(1e-3), 1e-6 * F.col("size"))
    return c.select(F.col("id").alias("strip"), *[F.round(n, 9).alias(n) for n in ("size", "covered", "overlapped", "gap")], within.alias("within_tolerance"))


@query(
    "geo_04_differences",
    raster("""WITH a AS (SELECT node, count(*) / 64.0::DOUBLE AS area FROM v_points GROUP BY 1),
    i AS (SELECT a.node AS a, b.node AS b, count(*) / 64.0::DOUBLE AS common FROM v_points a JOIN v_points b USING (gx, gy, q) WHERE a.node < b.node GROUP BY 1, 2)
    SELECT i.a, i.b, common, x.area - common AS only_a, y.area - common AS only_b, x.area + y.area - 2 * common AS either FROM i JOIN a x ON x.node = i.a JOIN a y ON y.node = i.b"""),
)
def geo_04_differences(v):
    """Intersection, differences and symmetric difference of shapes that overlap."""
    traps = O.trapezoids(shapes(v), CELL)
    size = traps.groupBy("id").agg(O.area().alias("area"))
    common = O.intersections(traps, traps, CELL, ordered=True).groupBy("a", "b").agg(O.area().alias("common")).where("common > 1e-9")
    both = common.join(size.select(F.col("id").alias("a"), F.col("area").alias("x")).hint("merge"), "a").join(size.select(F.col("id").alias("b"), F.col("area").alias("y")).hint("merge"), "b")
    r = lambda c, n: F.round(c, 9).alias(n)
    return both.select("a", "b", r(F.col("common"), "common"), r(F.col("x") - F.col("common"), "only_a"), r(F.col("y") - F.col("common"), "only_b"), r(F.col("x") + F.col("y") - 2 * F.col("common"), "either"))


@query(
    "geo_05_overlaps",
    raster("""WITH a AS (SELECT node, count(*) / 64.0::DOUBLE AS area FROM v_points GROUP BY 1),
    i AS (SELECT a.node AS a, b.node AS b, count(*) / 64.0::DOUBLE AS overlap FROM v_points a JOIN v_points b USING (gx, gy, q) WHERE a.node < b.node GROUP BY 1, 2)
    SELECT i.a, i.b, overlap, round(100 * overlap / least(x.area, y.area), 6) AS smaller_percent, p.district <> r.district AS crosses
    FROM i JOIN a x ON x.node = i.a JOIN a y ON y.node = i.b JOIN v_plans p ON p.node = i.a AND p.plan = 'cols' JOIN v_plans r ON r.node = i.b AND r.plan = 'cols'"""),
)
def geo_05(v):
    """Overlaps, what share of the smaller shape they are, and whether they cross districts."""
    traps = O.trapezoids(shapes(v), CELL)
    size = traps.groupBy("id").agg(O.area().alias("area")).join(v.plans.where("plan = 'cols'").select(F.col("node").alias("id"), "district").hint("merge"), "id")
    common = O.intersections(traps, traps, CELL, ordered=True).groupBy("a", "b").agg(O.area().alias("overlap")).where("overlap > 1e-9")
    side = lambda s: size.select(F.col("id").alias(s), F.col("area").alias(f"{s}_area"), F.col("district").alias(f"{s}_district"))
    both = common.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.select("a", "b", F.round("overlap", 9).alias("overlap"), F.round(100 * F.col("overlap") / F.least("a_area", "b_area"), 6).alias("smaller_percent"), (F.col("a_district") != F.col("b_district")).alias("crosses"))


@query("geo_01_validity", "SELECT CASE node % 9 WHEN 6 THEN 'self-intersection' WHEN 7 THEN 'spike' WHEN 8 THEN 'rings cross' ELSE 'valid' END AS reason, count(*) AS polygons FROM v_units GROUP BY 1")
def geo_01(v):
    return G.faults(shapes(v)).groupBy(F.coalesce("fault", F.lit("valid")).alias("reason")).agg(F.count("*").alias("polygons"))


@query(
    "geo_02_repair",
    raster("""WITH a AS (SELECT node, count(*) / 64.0::DOUBLE AS area FROM v_points GROUP BY 1)
    SELECT node AS id, CASE node % 9 WHEN 6 THEN 'self-intersection' WHEN 7 THEN 'spike' ELSE 'rings cross' END AS reason,
    CASE WHEN node % 2 = 1 THEN 'refused: not authorised' WHEN node % 9 = 6 THEN 'repaired' ELSE 'refused: moves a boundary' END AS outcome,
    CASE WHEN node % 2 = 0 THEN CASE node % 9 WHEN 6 THEN 2 ELSE 1 END ELSE 1 END::INTEGER AS parts, CASE WHEN node % 2 = 0 THEN area END AS area_after,
    CASE WHEN node % 2 = 0 AND node % 9 = 6 THEN TRUE END AS valid FROM a WHERE node % 9 >= 6"""),
)
def geo_02(v):
    """Repairs by the even-odd rule of the shapes that are authorised (those of even number), unless a corner would
    move by a quarter of a cell; what is repaired is valid."""
    r = G.repairs(shapes(v).where("id % 2 = 0"), most_displaced=0.24, types=("Polygon", "MultiPolygon"))
    refused = G.repairs(shapes(v).where("id % 2 = 1"), authorised=[])
    both = r.unionByName(refused)
    valid = G.measures(both.where("repaired IS NOT NULL").select("id", F.col("repaired").alias("wkb"))).select("id", F.col("fault").isNull().alias("valid"))
    return both.join(valid, "id", "left").select("id", "reason", "outcome", "parts", F.round("area_after", 9).alias("area_after"), "valid")


@query("geo_09_parts", "SELECT node AS id, CASE node % 9 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS parts, CASE node % 9 WHEN 2 THEN 1 WHEN 8 THEN 2 ELSE 0 END::BIGINT AS holes FROM v_units")
def geo_09(v):
    """Parts of each shape, and their holes."""

    def count(batches):
        for pdf in batches:
            parts = [G.parts_of(w) for w in pdf["wkb"]]
            pdf["parts"], pdf["holes"] = [len(p) for p in parts], [sum(len(rings) - 1 for rings in p) for p in parts]
            yield pdf[["id", "parts", "holes"]]

    return shapes(v).mapInPandas(count, "id long, parts long, holes long")
