"""Planar geometry on rings of coordinates: measures, validity, clipping, boundaries, adjacency.

Polygons travel as WKB. Everything here looks at one shape, or two, at a time, as helpers of Spark jobs; clips are
of convex windows. Overlays of shapes of any form are joins: see mapstats.operators.overlay.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapstats.session import spread

Ring = list[tuple[float, float]]


def wkb_polygon(rings: list[Ring]) -> bytes:
    out = struct.pack("<BII", 1, 3, len(rings))
    return out + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[c for p in r for c in p]) for r in rings)


def rings_of(wkb: bytes) -> list[Ring]:
    mark = "<" if wkb[0] == 1 else ">"
    kind, n = struct.unpack(f"{mark}II", wkb[1:9])
    if kind != 3:
        raise ValueError(f"WKB type {kind} is no polygon")
    at, out = 9, []
    for _ in range(n):
        m = struct.unpack(f"{mark}I", wkb[at : at + 4])[0]
        flat = struct.unpack(f"{mark}{2 * m}d", wkb[at + 4 : at + 4 + 16 * m])
        out.append(list(zip(flat[::2], flat[1::2], strict=True)))
        at += 4 + 16 * m
    return out


def wkb_multi(parts: list[list[Ring]]) -> bytes:
    """One polygon, or several as a multipolygon."""
    if len(parts) == 1:
        return wkb_polygon(parts[0])
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(wkb_polygon, parts))


def parts_of(wkb: bytes) -> list[list[Ring]]:
    """The polygons of a polygon or multipolygon."""
    mark = "<" if wkb[0] == 1 else ">"
    kind, n = struct.unpack(f"{mark}II", wkb[1:9])
    if kind == 3:
        return [rings_of(wkb)] if n else []
    if kind != 6:
        raise ValueError(f"WKB type {kind} is no polygon or multipolygon")
    at, out = 9, []
    for _ in range(n):
        rings = rings_of(wkb[at:])
        out.append(rings)
        at += 9 + sum(4 + 16 * len(r) for r in rings)
    return out


def places(wkb: bytes) -> list[tuple[int, np.ndarray]]:
    """Of each ring of a polygon or multipolygon of this module's byte order: where its points begin, and the points."""
    polygons, at, out = 1, 0, []
    if struct.unpack("<I", wkb[1:5])[0] == 6:
        polygons, at = struct.unpack("<I", wkb[5:9])[0], 9
    for _ in range(polygons):
        rings = struct.unpack("<I", wkb[at + 5 : at + 9])[0]
        at += 9
        for _ in range(rings):
            m = struct.unpack("<I", wkb[at : at + 4])[0]
            out.append((at + 4, np.frombuffer(wkb, "<f8", 2 * m, at + 4).reshape(m, 2)))
            at += 4 + 16 * m
    return out


def closed(ring: Ring) -> Ring:
    return ring if ring and ring[0] == ring[-1] else [*ring, *ring[:1]]


def signed_area(ring: Ring) -> float:
    r = np.array(closed(ring))
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2) if len(r) > 3 else 0.0


def area(rings: list[Ring]) -> float:
    """The outer ring less the holes."""
    return abs(signed_area(rings[0])) - sum(abs(signed_area(r)) for r in rings[1:]) if rings else 0.0


def length(rings: list[Ring]) -> float:
    return sum(math.dist(p, q) for r in rings for p, q in zip(closed(r), closed(r)[1:], strict=False))


def centroid(parts: list[list[Ring]]) -> tuple[float, float] | None:
    """Of all parts, holes taken out."""
    total, mx, my = 0.0, 0.0, 0.0
    for rings in parts:
        for k, ring in enumerate(rings):
            r = np.array(closed(ring))
            if len(r) < 4:
                continue
            cross = r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]
            sign = (1 if k == 0 else -1) * (1 if cross.sum() > 0 else -1)
            total += sign * float(cross.sum()) / 2
            mx += sign * float(((r[:-1, 0] + r[1:, 0]) * cross).sum()) / 6
            my += sign * float(((r[:-1, 1] + r[1:, 1]) * cross).sum()) / 6
    return (mx / total, my / total) if total else None


def contains(rings: list[Ring], x: float, y: float) -> bool:
    """Whether the point lies inside, by crossings of all rings."""
    inside = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(closed(r), closed(r)[1:], strict=False):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def _edges(rings: list[Ring]) -> np.ndarray:
    """n x 4: the edges of all rings that have a length."""
    e = [(*p, *q) for r in rings for p, q in zip(closed(r), closed(r)[1:], strict=False) if p != q]
    return np.array(e, dtype=float).reshape(-1, 4)


def _sides(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each edge (rows), on which side points (columns) lie: 1, 0 or -1; 0 within rounding."""
    ax, ay, bx, by = (e[:, k, None] for k in range(4))
    turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    slack = 1e-12 * (np.abs(bx - ax) + np.abs(by - ay)) * (np.abs(np.concatenate([x.ravel(), y.ravel()])).max(initial=1.0) + 1)
    return np.where(np.abs(turn) <= slack, 0, np.sign(turn)).astype(int)


def _contacts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices of pairs of edges: that cross inside both, and that lie on one another for a stretch."""
    start, end = _sides(e, e[None, :, 0], e[None, :, 1]), _sides(e, e[None, :, 2], e[None, :, 3])
    apart = start * end < 0
    flat = (start == 0) & (end == 0)
    d = e[:, 2:] - e[:, :2]
    size = np.maximum((d**2).sum(1), 1e-300)
    along = lambda c: ((e[None, :, c : c + 2] - e[:, None, :2]) * d[:, None]).sum(2) / size[:, None]
    s, t = along(0), along(2)
    lies = flat & (np.minimum(np.maximum(s, t), 1) - np.maximum(np.minimum(s, t), 0) > 1e-9)
    np.fill_diagonal(lies, False)
    return apart & apart.T, lies


def fault(parts: list[list[Ring]]) -> str | None:
    """Why a polygon or multipolygon is not valid; None if it is."""
    rings = [r for rings in parts for r in rings]
    if not rings or not all(rings and rings[0] for rings in parts):
        return "empty"
    for r in rings:
        if not all(math.isfinite(c) for p in r for c in p):
            return "non-finite coordinate"
        if len(set(r)) < 3:
            return "too few points"
    for r in rings:
        cross, lies = _contacts(_edges([r]))
        if cross.any():
            return "self-intersection"
        if lies.any():
            return "spike"
        if signed_area(r) == 0:
            return "no area"
    if len(rings) == 1:
        return None
    cross, lies = _contacts(_edges(rings))
    if cross.any() or lies.any():
        return "rings cross"
    for k, own in enumerate(parts):
        if not all(_within(hole, own[0]) for hole in own[1:]):
            return "hole outside its shell"
        if any(_within(a, b) for i, a in enumerate(own[1:]) for j, b in enumerate(own[1:]) if i != j):
            return "nested holes"
        if any(_within(own[0], other[0]) and not any(_within(own[0], h) for h in other[1:]) for j, other in enumerate(parts) if j != k):
            return "nested parts"
    return None


def _within(inner: Ring, outer: Ring) -> bool:
    """Whether a ring lies in another that it does not cross: any of its points off the other's line tells."""
    e = _edges([outer])
    for x, y in inner:
        on = (_sides(e, np.array([[x]]), np.array([[y]])) == 0)[:, 0] & (np.minimum(e[:, 0], e[:, 2]) <= x) & (x <= np.maximum(e[:, 0], e[:, 2])) & (np.minimum(e[:, 1], e[:, 3]) <= y) & (y <= np.maximum(e[:, 1], e[:, 3]))
        if not on.any():
            return contains([outer], x, y)
    return True


def _noded(e: np.ndarray) -> set[tuple]:
    """The edges cut where they meet one another, each as an ordered pair of points; what lies twice goes. Points
    closer than rounding errors become one."""
    same: dict[tuple[int, int], tuple[float, float]] = {}
    grid = 1e-10 * (np.abs(e).max(initial=1.0) + 1)

    def node(p: tuple[float, float]) -> tuple[float, float]:
        x, y = round(p[0] / grid), round(p[1] / grid)
        for a in (x, x - 1, x + 1):
            for b in (y, y - 1, y + 1):
                if (a, b) in same:
                    return same[a, b]
        return same.setdefault((x, y), p)

    for p in np.unique(np.concatenate([e[:, :2], e[:, 2:]]), axis=0).tolist():
        node(tuple(p))
    marks: list[dict[float, tuple[float, float]]] = [{0.0: tuple(x[:2].tolist()), 1.0: tuple(x[2:].tolist())} for x in e]
    cross, _ = _contacts(e)
    d = e[:, 2:] - e[:, :2]
    for i, j in np.argwhere(np.triu(cross)).tolist():
        t = ((e[j, 0] - e[i, 0]) * d[j, 1] - (e[j, 1] - e[i, 1]) * d[j, 0]) / (d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0])
        p = node((float(e[i, 0] + t * d[i, 0]), float(e[i, 1] + t * d[i, 1])))
        for k in (i, j):
            marks[k][float(((np.array(p) - e[k, :2]) * d[k]).sum() / (d[k] ** 2).sum())] = p
    points = np.array(sorted(set(same.values())))
    near = _sides(e, points[None, :, 0], points[None, :, 1]) == 0
    for k, j in np.argwhere(near).tolist():
        t = float(((points[j] - e[k, :2]) * d[k]).sum() / (d[k] ** 2).sum())
        if 0 < t < 1:
            marks[k][t] = (float(points[j, 0]), float(points[j, 1]))
    kept: set[tuple] = set()
    for own in marks:
        line = [own[t] for t in sorted(own)]
        for p, q in zip(line, line[1:], strict=False):
            if p != q:
                kept ^= {(min(p, q), max(p, q))}
    return kept


def _faces(edges: set[tuple]) -> list[Ring]:
    """Rings around what lies inside by the even-odd rule, with the inside to their left. Rings that only touch in a
    point stay rings of their own."""
    if not edges:
        return []
    e = np.array(sorted((*p, *q) for p, q in edges))
    steep = e[:, 0] == e[:, 2]
    mx, my = (e[:, 0] + e[:, 2]) / 2, (e[:, 1] + e[:, 3]) / 2
    ax, ay, bx, by = (e[:, k, None] for k in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        below = ((ax <= mx) & (mx < bx) & (ay + (mx - ax) * (by - ay) / (bx - ax) < my)).astype(int)
        low, high = np.minimum(ay, by), np.maximum(ay, by)
        left = ((low <= my) & (my < high) & (ax + (my - ay) * (bx - ax) / (by - ay) < mx)).astype(int)
    np.fill_diagonal(below, 0)
    np.fill_diagonal(left, 0)
    # An edge has the inside above it (or, if it goes straight up, to its right) where an even number lies before it.
    forward = np.where(steep, left.sum(0) % 2 == 1, below.sum(0) % 2 == 0)
    out: dict[tuple, list[tuple]] = {}
    for k, x in enumerate(e.tolist()):
        p, q = (tuple(x[:2]), tuple(x[2:])) if forward[k] else (tuple(x[2:]), tuple(x[:2]))
        out.setdefault(p, []).append(q)
    rings = []
    while out:
        start = min(out)
        ring, at = [start], start
        back = None
        while True:
            ways = out[at]
            if back is None:
                to = min(ways)
            else:
                turned = lambda w: (math.atan2(back[1] - at[1], back[0] - at[0]) - math.atan2(w[1] - at[1], w[0] - at[0])) % (2 * math.pi)  # noqa: B023, E731
                to = min(ways, key=lambda w: turned(w) or 2 * math.pi)
            ways.remove(to)
            if not ways:
                del out[at]
            ring.append(to)
            if to == start:
                break
            back, at = at, to
        rings += _loops(ring)
    return rings


def _loops(ring: Ring) -> list[Ring]:
    """A closed ring that touches itself as rings that do not."""
    out, path, place = [], [], {}
    for p in ring:
        if p in place:
            out.append([*path[place[p] :], p])
            for x in path[place[p] + 1 :]:
                del place[x]
            del path[place[p] + 1 :]
        else:
            place[p] = len(path)
            path.append(p)
    return out


def rebuilt(parts: list[list[Ring]]) -> list[list[Ring]]:
    """Valid polygons of the same area by the even-odd rule: noded, and their rings traced anew."""
    rings = _faces(_noded(_edges([r for rings in parts for r in rings])))
    shells = sorted((r for r in rings if signed_area(r) > 0), key=signed_area)
    out = [[r] for r in shells]
    for hole in (r for r in rings if signed_area(r) < 0):
        next(x for x, shell in zip(out, shells, strict=True) if abs(signed_area(hole)) < signed_area(shell) and _within(hole, shell)).append(hole)
    return sorted(out)


def displacement(before: list[list[Ring]], after: list[list[Ring]]) -> float:
    """How far a corner of either lies from the lines of the other, at most."""
    a, b = ([r for rings in parts for r in rings] for parts in (before, after))

    def away(points: list[Ring], rings: list[Ring]) -> float:
        p, e = np.array([x for r in points for x in r]), _edges(rings)
        if not len(p) or not len(e):
            return math.inf
        d = e[:, 2:] - e[:, :2]
        t = np.clip(((p[:, None] - e[None, :, :2]) * d).sum(2) / (d**2).sum(1), 0, 1)
        return float(np.sqrt(((e[None, :, :2] + t[..., None] * d - p[:, None]) ** 2).sum(2)).min(1).max())

    return max(away(a, b), away(b, a))


REPAIR = "reason string, outcome string, parts int, area_before double, area_after double, displacement double, repaired binary"


def repairs(shapes: DataFrame, authorised: list | None = None, most_displaced: float = 0.0, types: tuple[str, ...] = ("Polygon",), key: str = "id") -> DataFrame:
    """Invalid shapes with what became of them: `repaired`, or `refused:` and why. Only those of the list are repaired,
    if one is given; a repair may not change the type to one that is not in `types`, nor move a corner further than
    `most_displaced`. Areas before are those inside by the even-odd rule in sum of rings (holes less)."""
    kind = dict(shapes.dtypes)[key]
    allowed = None if authorised is None else set(authorised)

    def one(k, wkb: bytes | None) -> tuple | None:
        before = parts_of(wkb) if wkb else []
        why = fault(before)
        if why is None:
            return None
        size = sum(area(rings) for rings in before)
        if allowed is not None and k not in allowed:
            return why, "refused: not authorised", len(before), size, None, None, None
        if why in ("empty", "non-finite coordinate"):
            return why, f"refused: {why}", len(before), size, None, None, None
        after = rebuilt(before)
        if not after or fault(after) is not None:
            return why, "refused: nothing valid is left", len(after), size, None, None, None
        moved, kind_ = displacement(before, after), "Polygon" if len(after) == 1 else "MultiPolygon"
        done = (len(after), size, sum(area(rings) for rings in after), moved)
        if kind_ not in types:
            return why, f"refused: becomes a {kind_}", *done, None
        if moved > most_displaced:
            return why, "refused: moves a boundary", *done, None
        return why, "repaired", *done, wkb_multi(after)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in REPAIR.split(", ")]
        types_ = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
        for batch in batches:
            keys = batch.column(key).to_pylist()
            got = [(k, r) for k, w in zip(keys, batch.column("wkb").to_pylist(), strict=True) if (r := one(k, w)) is not None]
            cols = [pa.array([k for k, _ in got], batch.column(key).type), *[pa.array([r[i] for _, r in got], t) for i, t in enumerate(types_)]]
            yield pa.RecordBatch.from_arrays(cols, [key, *names])

    return shapes.select(key, "wkb").mapInArrow(run, f"{key} {kind}, {REPAIR}")


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def clip(subject: Ring, convex: Ring) -> Ring:
    """The part of a ring inside a convex ring."""
    window = [p for k, p in enumerate(convex) if k == 0 or p != convex[0]]
    if signed_area(window) < 0:
        window = window[::-1]
    out = [p for k, p in enumerate(subject) if k == 0 or p != subject[0]]
    for a, b in zip(window, [*window[1:], window[0]], strict=True):
        given, out = out, []
        for p, q in zip(given, [*given[1:], *given[:1]], strict=True):
            tp, tq = _turn(a, b, p), _turn(a, b, q)
            if tp >= 0:
                out.append(p)
            if (tp > 0 > tq) or (tp < 0 < tq):
                t = tp / (tp - tq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return []
    return out


def overlap(a: list[Ring], b: list[Ring]) -> float:
    return abs(signed_area(c)) if a and b and len(c := clip(a[0], b[0])) > 2 else 0.0


def difference_area(a: list[Ring], b: list[Ring]) -> float:
    return area(a) - overlap(a, b)


def coverage_tolerance(size: float) -> float:
    return max(1e-3, 1e-6 * size)


def snapped(rings: list[Ring], grid: float) -> list[Ring]:
    return [[(round(x / grid) * grid, round(y / grid) * grid) for x, y in r] for r in rings]


def shared_boundary(a: list[Ring], b: list[Ring]) -> float:
    """Length of the collinear stretches that both boundaries have."""
    total = 0.0
    for r in a:
        for p, q in zip(closed(r), closed(r)[1:], strict=False):
            size = math.dist(p, q)
            if not size:
                continue
            for s in b:
                for u, v in zip(closed(s), closed(s)[1:], strict=False):
                    if abs(_turn(p, q, u)) <= 1e-9 * size and abs(_turn(p, q, v)) <= 1e-9 * size:
                        t = sorted(((x[0] - p[0]) * (q[0] - p[0]) + (x[1] - p[1]) * (q[1] - p[1])) / size for x in (u, v))
                        total += max(0.0, min(size, t[1]) - max(0.0, t[0]))
    return total


def hausdorff(a: Ring, b: Ring) -> float:
    """Discrete, between vertices."""
    x, y = np.array(a), np.array(b)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    return float(max(d.min(axis=1).max(), d.min(axis=0).max()))


MEASURES = "area double, length double, x double, y double, min_x double, min_y double, max_x double, max_y double, fault string"


def measures(shapes: DataFrame, key: str = "id") -> DataFrame:
    """Area, length, centroid, box and fault of every polygon."""
    kind = dict(shapes.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for w in batch.column("wkb").to_pylist():
                parts = parts_of(w) if w else []
                r = [ring for rings in parts for ring in rings]
                why = fault(parts)
                p = np.array([x for rings in parts for x in rings[0]]) if r and r[0] else None
                c = centroid(parts) if p is not None else None
                row = (sum(area(rings) for rings in parts), length(r), *(c or (None, None)), *((*map(float, p.min(axis=0)), *map(float, p.max(axis=0))) if p is not None else [None] * 4), why)
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, pa.float64()) for c in cols[:8]], pa.array(cols[8], pa.string())], names=[key, *[m.split()[0] for m in MEASURES.split(", ")]])

    return shapes.select(key, "wkb").mapInArrow(run, f"{key} {kind}, {MEASURES}")


def single_rings(blobs: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and n x points x 2 of the polygons of one closed ring with equal numbers of points; what is not one of these is left out."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(blobs):
        if w and w[:9] == b"\x01\x03\0\0\0\x01\0\0\0" and len(w) > 29:
            by.setdefault(len(w), []).append(k)
    for size, at in by.items():
        raw = np.frombuffer(b"".join(blobs[k] for k in at), dtype=np.uint8).reshape(len(at), size)
        p = np.ascontiguousarray(raw[:, 13:]).view("<f8").reshape(len(at), -1, 2)
        whole = (p[:, 0] == p[:, -1]).all(1)
        yield np.array(at)[whole], p[whole]


def ring_faults(p: np.ndarray) -> list[str | None]:
    """fault of each of n polygons of one closed ring, n x points x 2; _contacts of all of them at once."""
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = p[:, :-1], p[:, 1:]
        d, long = b - a, (b != a).any(2)
        reach = np.abs(p).max((1, 2)).clip(1.0) + 1
        slack = 1e-12 * np.abs(d).sum(2) * reach[:, None]
        rel = lambda u: u[:, None] - a[:, :, None]

        def side(u: np.ndarray) -> np.ndarray:
            r = rel(u)
            turn = d[:, :, None, 0] * r[..., 1] - d[:, :, None, 1] * r[..., 0]
            return np.where(np.abs(turn) <= slack[:, :, None], 0, np.sign(turn))

        start, end = side(a), side(b)
        both = long[:, :, None] & long[:, None]
        apart = (start * end < 0) & both
        size = np.maximum((d**2).sum(2), 1e-300)[:, :, None]
        s, t = ((rel(u) * d[:, :, None]).sum(3) / size for u in (a, b))
        lies = (start == 0) & (end == 0) & both & (np.minimum(np.maximum(s, t), 1) - np.maximum(np.minimum(s, t), 0) > 1e-9)
        lies &= ~np.eye(p.shape[1] - 1, dtype=bool)
        flat = (a[..., 0] * b[..., 1] - b[..., 0] * a[..., 1]).sum(1) == 0
        cross, spike = (apart & apart.transpose(0, 2, 1)).any((1, 2)), lies.any((1, 2))
    code = np.select([~np.isfinite(p).all((1, 2)), cross, spike, flat], [1, 2, 3, 4], 0)
    names = (None, "non-finite coordinate", "self-intersection", "spike", "no area")
    few = (p[:, :, None] == p[:, None]).all(3)
    few = (~np.tril(few, -1).any(2)).sum(1) < 3  # points that none before is equal to
    return ["too few points" if f and c != 1 else names[c] for c, f in zip(code.tolist(), few.tolist(), strict=True)]


def faults(shapes: DataFrame, key: str = "id") -> DataFrame:
    """key and fault of every polygon, as measures has it, and nothing else worked out."""
    kind = dict(shapes.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("wkb").to_pylist()
            why: list[str | None] = [None] * len(blobs)
            rest = set(range(len(blobs)))
            for at, p in single_rings(blobs):
                if p.shape[1] > 256:
                    continue
                step = max(1, (1 << 18) // p.shape[1] ** 2)
                for k in range(0, len(at), step):
                    for i, w in zip(at[k : k + step].tolist(), ring_faults(p[k : k + step]), strict=True):
                        why[i] = w
                rest.difference_update(at.tolist())
            for i in rest:
                why[i] = fault(parts_of(blobs[i]) if blobs[i] else [])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(why, pa.string())], names=[key, "fault"])

    return shapes.select(key, "wkb").mapInArrow(run, f"{key} {kind}, fault string")


def shared_boundaries(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """shared_boundary of each of n pairs of closed rings, n x points x 2."""
    a, d = p[:, :-1, None], p[:, 1:, None] - p[:, :-1, None]
    size = np.hypot(d[..., 0], d[..., 1])
    turn = lambda u: np.abs(d[..., 0] * (u[..., 1] - a[..., 1]) - d[..., 1] * (u[..., 0] - a[..., 0]))
    along = lambda u: ((u - a) * d).sum(-1) / np.where(size > 0, size, 1)
    u, v = q[:, None, :-1], q[:, None, 1:]
    on = (size > 0) & (turn(u) <= 1e-9 * size) & (turn(v) <= 1e-9 * size)
    s, t = along(u), along(v)
    return np.where(on, np.maximum(0.0, np.minimum(size, np.maximum(s, t)) - np.maximum(0.0, np.minimum(s, t))), 0.0).sum((1, 2))


def _shared(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """shared_boundary of each pair; those of single rings many at once."""
    out, kind = np.full(len(x), np.nan), np.zeros((2, len(x)), dtype=np.int64)
    rings: list[dict[int, np.ndarray]] = [{}, {}]
    place = np.zeros((2, len(x)), dtype=np.int64)
    for side, blobs in enumerate((x, y)):
        for at, p in single_rings(blobs):
            kind[side, at], place[side, at], rings[side][p.shape[1]] = p.shape[1], np.arange(len(at)), p
    for m, n in np.unique(kind.T[kind.all(0)], axis=0).tolist():
        at = np.flatnonzero((kind[0] == m) & (kind[1] == n))
        step = max(1, (1 << 18) // (m * n))
        for some in (at[k : k + step] for k in range(0, len(at), step)):
            out[some] = shared_boundaries(rings[0][m][place[0, some]], rings[1][n][place[1, some]])
    for k in np.flatnonzero(~kind.all(0)).tolist():
        out[k] = shared_boundary(rings_of(x[k]), rings_of(y[k]))
    return out


def boxed(shapes: DataFrame, key: str = "id") -> DataFrame:
    """Polygons with the box of their outer rings, as measures has it, and nothing else worked out."""
    kind = dict(shapes.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("wkb").to_pylist()
            ends: list[tuple | None] = [None] * len(blobs)
            for at, p in single_rings(blobs):
                for k, box in zip(at.tolist(), np.concatenate([p.min(1), p.max(1)], 1).tolist(), strict=True):
                    ends[k] = box
            for k in (k for k, box in enumerate(ends) if box is None):
                parts = parts_of(blobs[k]) if blobs[k] else []
                r = [ring for rings in parts for ring in rings]
                p = np.array([x for rings in parts for x in rings[0]]) if r and r[0] else None
                ends[k] = (*map(float, p.min(axis=0)), *map(float, p.max(axis=0))) if p is not None else (None,) * 4
            sides = [pa.array([e[k] for e in ends], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("wkb"), *sides], names=[key, "wkb", "min_x", "min_y", "max_x", "max_y"])

    return shapes.select(key, "wkb").mapInArrow(run, f"{key} {kind}, wkb binary, min_x double, min_y double, max_x double, max_y double")


def cells(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each grid cell that a box touches."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return boxes.withColumn("cx", F.explode(span("min_x", "max_x"))).withColumn("cy", F.explode(span("min_y", "max_y")))


def neighbours(shapes: DataFrame, size: float, key: str = "id") -> DataFrame:
    """Pairs a < b of polygons whose boxes meet, with their overlap and shared boundary: an equi-join on
    grid cells, in which each pair is found in the first cell that both touch. Only pairs whose boxes have an area in common are clipped."""
    kind = dict(shapes.dtypes)[key]
    c = spread(cells(boxed(shapes, key), size), "cx", "cy")
    names = (key, "wkb", "min_x", "min_y", "max_x", "max_y")
    a, b = (c.select("cx", "cy", *[F.col(n).alias(f"{s}_{n}") for n in names]) for s in "ab")
    first_x, first_y = F.floor(F.greatest("a_min_x", "b_min_x") / size), F.floor(F.greatest("a_min_y", "b_min_y") / size)
    meet = (F.col("a_min_x") <= F.col("b_max_x")) & (F.col("b_min_x") <= F.col("a_max_x")) & (F.col("a_min_y") <= F.col("b_max_y")) & (F.col("b_min_y") <= F.col("a_max_y"))
    pairs = a.join(b, ["cx", "cy"]).where((F.col(f"a_{key}") < F.col(f"b_{key}")) & meet & (F.col("cx") == first_x) & (F.col("cy") == first_y))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(f"{s}_wkb").to_pylist() for s in "ab")
            over = np.zeros(len(x))
            for k in np.flatnonzero(batch.column("area").to_numpy(zero_copy_only=False)).tolist():
                over[k] = overlap(rings_of(x[k]), rings_of(y[k]))
            yield pa.RecordBatch.from_arrays([batch.column(f"a_{key}"), batch.column(f"b_{key}"), pa.array(over), pa.array(_shared(x, y))], names=["a", "b", "overlap", "shared"])

    area = (F.greatest("a_min_x", "b_min_x") < F.least("a_max_x", "b_max_x")) & (F.greatest("a_min_y", "b_min_y") < F.least("a_max_y", "b_max_y"))
    return pairs.select(f"a_{key}", f"b_{key}", "a_wkb", "b_wkb", area.alias("area")).mapInArrow(run, f"a {kind}, b {kind}, overlap double, shared double")


def within(points: DataFrame, shapes: DataFrame, size: float, key: str = "id") -> DataFrame:
    """Left join of points (x, y) to the polygon of least key that contains them."""
    kind = dict(shapes.dtypes)[key]
    near = spread(points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}), "cx", "cy")
    near = near.join(spread(cells(boxed(shapes, key), size), "cx", "cy").select("cx", "cy", F.col(key).alias("shape"), "wkb"), ["cx", "cy"]).select("point", "x", "y", "shape", "wkb")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([contains(rings_of(w), x, y) for w, x, y in zip(*(batch.column(c).to_pylist() for c in ("wkb", "x", "y")), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("point", "shape")], names=["point", "shape"])

    hit = near.mapInArrow(run, f"point long, shape {kind}").groupBy("point").agg(F.min("shape").alias("shape"))
    return points.join(hit, "point", "left")
