import hashlib
import io
import math
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from mapstats.functions import geometry as G
from mapstats.operators import contracts as C
from mapstats.sources import files


def dbf(rows, cut=0):
    fields = [("GEOID20", 15), ("P0010001", 8)]
    width = 1 + sum(n for _, n in fields)
    head = struct.pack("<4sIHH20x", b"\x03\x7e\x01\x01", len(rows), 32 + 32 * len(fields) + 1, width)
    head += b"".join(n.encode().ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([size]) + b"\0" * 15 for n, size in fields) + b"\r"
    body = b"".join((b"*" if gone else b" ") + geoid.encode().ljust(15) + str(pop).encode().rjust(8) for geoid, pop, gone in rows)
    return (head + body)[: len(head + body) - cut]


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)


def test_dbf(spark, tmp_path):
    rows = [("37" + "0" * 12 + str(k), k % 2 * 7, k == 3) for k in range(5)]
    archive(tmp_path / "a.zip", blocks__dbf=dbf(rows))
    (tmp_path / "b.dbf").write_bytes(dbf(rows[:1]))
    schema = "GEOID20 string, P0010001 long"
    got = files.read_dbf(spark, f"{tmp_path}/a.zip", schema).collect()
    assert sorted(map(tuple, got)) == [(g, p) for g, p, gone in rows if not gone]
    assert files.read_dbf(spark, f"{tmp_path}/b.dbf", schema).count() == 1
    with pytest.raises(ValueError, match="cut off"):
        list(files.dbf_rows(dbf(rows, cut=3), ["GEOID20"]))
    with pytest.raises(ValueError, match="missing"):
        list(files.dbf_rows(dbf(rows), ["TOTPOP"]))


def test_zip_csv(spark, tmp_path):
    archive(tmp_path / "plan.zip", plan__csv="﻿Block,District\n370000000000001,01\n370000000000002,2\n")
    got = files.read_zip_csv(spark, f"{tmp_path}/plan.zip", "SCTBKEY string, DISTRICT int", aliases={"Block": "SCTBKEY", "District": "DISTRICT"})
    assert sorted(map(tuple, got.collect())) == [("370000000000001", 1), ("370000000000002", 2)]
    archive(tmp_path / "two.zip", a__csv="x\n1\n", b__csv="x\n1\n")
    with pytest.raises(Exception, match="one is needed"):
        files.read_zip_csv(spark, f"{tmp_path}/two.zip", "x int").collect()


def test_shapes(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (3.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 3, 2, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    record = struct.pack(">ii", 1, len(body) // 2) + body
    head = struct.pack(">i5xi", 9994, 0)[:4] + b"\0" * 96
    (tmp_path / "x.shp").write_bytes(head + record)
    shapes = files.read_shapes(spark, f"{tmp_path}/x.shp").withColumnRenamed("record", "id")
    row = G.measures(shapes).first()
    assert (row.area, row.length, row.x, row.y, row.fault) == (6, 10, 1.5, 1, None)


def test_catalog_and_manifest(spark, tmp_path):
    rows = [("NC blocks ", "csv", "https://u:p@host.org/a/nc%20blocks.zip?key=1"), ("TX", "shp", "http://host.org/x.zip"), ("none", "csv", "https://host.org/")]
    got = files.catalog(spark.createDataFrame(rows, "Title string, Format string, URL string")).collect()
    assert [tuple(r) for r in got] == [("NC blocks", "CSV", "https://host.org/a/nc%20blocks.zip", "nc blocks.zip")]
    (tmp_path / "m.json").write_text('{"version": 2}')
    with pytest.raises(ValueError, match="version"):
        files.read_manifest(spark, f"{tmp_path}/m.json", version=1)


def test_receipts_and_publish(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    r = files.receipts(spark, f"{tmp_path}/f.bin").first()
    assert (r["bytes"], r.sha256) == (3, hashlib.sha256(b"abc").hexdigest())
    df = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert files.report(df).first().value == '{"a":1,"b":null}'
    x = spark.createDataFrame([(1, "u")], "a int, b string")
    assert files.publish(x, f"{tmp_path}/out") and not files.publish(x, f"{tmp_path}/out")
    with pytest.raises(FileExistsError):
        files.publish(x.limit(0), f"{tmp_path}/out")


def test_contracts(spark):
    df = spark.createDataFrame([(1, 2.0), (1, float("inf"))], "k int, v double")
    with pytest.raises(C.ContractError, match="unique"):
        C.require_unique(df, "k")
    with pytest.raises(C.ContractError, match="non-finite"):
        C.require_complete(df, "v")
    with pytest.raises(C.ContractError, match="missing"):
        C.require_columns(df, "z")
    with pytest.raises(C.ContractError, match="conserved"):
        C.require_totals(df, k=3)
    assert C.require_totals(df, k=2) is df


def box(x0, y0, x1, y1):
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def test_geometry(spark):
    a, b = box(0, 0, 2, 1), box(1, 0, 3, 1)
    assert G.overlap(a, b) == 1 and G.difference_area(a, b) == 1 and G.shared_boundary(box(0, 0, 1, 1), box(1, 0, 2, 1)) == 1
    assert G.shared_boundary(box(0, 0, 1, 1), box(1, 1, 2, 2)) == 0
    assert G.overlap(box(0, 0, 1, 1), box(1 - 1e-5, 1 - 1e-5, 2, 2)) == pytest.approx(1e-10)
    assert G.rings_of(G.wkb_polygon(a)) == a and G.contains(a, 1, 0.5) and not G.contains(a, 3, 0.5)
    assert G.fault([[[(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)]]]) == "self-intersection" and G.fault([]) == "empty"
    assert G.hausdorff(a[0], b[0]) == pytest.approx(1) and G.coverage_tolerance(1e6) == 1 and math.isclose(G.area(G.snapped(box(0.1, 0, 1.1, 1), 1)), 1)
    shapes = spark.createDataFrame([(k, G.wkb_polygon(s)) for k, s in enumerate([a, b, box(2, 1, 3, 2), box(9, 9, 10, 10)])], "id long, wkb binary")
    got = {(r.a, r.b): (r.overlap, r.shared) for r in G.neighbours(shapes, 1.0).collect()}
    assert got == {(0, 1): (1, 2), (0, 2): (0, 0), (1, 2): (0, 1)}
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 50.0, 50.0)], "point long, x double, y double")
    assert {r.point: r.shape for r in G.within(points, shapes, 1.0).collect()} == {1: 0, 2: 0, 3: None}
    assert io.BytesIO(G.wkb_polygon(a)).read(1) == b"\x01"


def test_segment_files(spark, tmp_path):
    head = "seed,step,dem_seats,plan_hash\n"
    write = lambda name, s, steps: (tmp_path / name).write_text(head + "".join(f"{s},{k},{k % 5},h{k // 3}\n" for k in steps))
    schema = "seed int, step long, dem_seats int, plan_hash string"
    write("x_seed1_steps000000-000001.csv", 1, range(2))
    write("x_seed1_steps000002-000004.csv", 1, range(2, 5))
    assert files.segment_faults(files.read_segments(spark, f"{tmp_path}/*.csv", schema)).count() == 0
    write("x_seed2_steps000000-000003.csv", 2, [0, 1, 3, 4])
    assert [r.file_seed for r in files.segment_faults(files.read_segments(spark, f"{tmp_path}/*.csv", schema)).collect()] == [2]


@pytest.mark.parametrize("make", ["boxes", "shapes"])
def test_work_on_shapes_is_spread(spark, make):
    """Rows of a few bytes each would be merged into one task, whatever a shape costs."""
    from mapstats.plans import io, overlay
    from mapstats.sources.views import Views

    made = {"boxes": io.boxes, "shapes": overlay.shapes}[make](Views(spark, "/root/testdata/sf0.001"))
    tasks = G.measures(made).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 2 * spark.sparkContext.defaultParallelism and max(t["count"] for t in tasks) < 40
    assert made.count() == 150


def test_boxes_are_those_of_measures(spark):
    names = ["min_x", "min_y", "max_x", "max_y"]
    multi = G.wkb_multi([[[(0.0, 0.0), (2.0, 0.0), (1.0, 3.0)]], [[(5.0, 5.0), (6.0, 5.0), (6.0, 7.0)], [(5.1, 5.1), (5.2, 5.1), (5.2, 5.2)]]])
    shapes = spark.createDataFrame([(1, bytearray(multi)), (2, None), (3, bytearray(G.wkb_polygon([[(1.0, 1.0), (2.0, 1.0), (2.0, 4.0)]])))], "id long, wkb binary")
    assert sorted(map(tuple, G.boxed(shapes).select("id", *names).collect())) == sorted(map(tuple, G.measures(shapes).select("id", *names).collect()))


def test_neighbours_work_on_many_pairs_at_once(spark, monkeypatch):
    """Boxes that only touch are not clipped, single rings not compared one by one; a holed one still is. The same figures either way."""
    ring = lambda *p: [*p, p[0]]
    one = {k: [ring((k % 4, k // 4), (k % 4 + 1, k // 4), (k % 4 + 1, k // 4 + 1), (k % 4, k // 4 + 1))] for k in range(12)}
    one[12] = [ring((0.5, 0.25), (2.5, 0.25), (1.0, 2.0))]
    one[13] = [*one[5], ring((1.25, 1.25), (1.75, 1.25), (1.75, 1.75), (1.25, 1.75))]
    points = {k: [[(float(x), float(y)) for x, y in r] for r in rings] for k, rings in one.items()}
    shapes = spark.createDataFrame([(k, bytearray(G.wkb_polygon(r))) for k, r in points.items()], "id long, wkb binary")
    got = {(r.a, r.b): (r.overlap, r.shared) for r in G.neighbours(shapes, 2.0).collect()}
    assert {k for k in got if max(k) < 12} == {(i, j) for i in range(12) for j in range(i + 1, 12) if abs(i % 4 - j % 4) <= 1 and abs(i // 4 - j // 4) <= 1}
    for (i, j), (over, shared) in got.items():
        assert over == pytest.approx(G.overlap(points[i], points[j]), abs=1e-12) and shared == pytest.approx(G.shared_boundary(points[i], points[j]), abs=1e-12)
    plain = [G.wkb_polygon(points[k]) for k in range(12)]
    monkeypatch.setattr(G, "shared_boundary", lambda *_: pytest.fail("pairs were compared one by one"))
    assert G._shared(plain[:-1], plain[1:]).tolist() == [float(k % 4 < 3) for k in range(11)]
