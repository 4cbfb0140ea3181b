"""Geometry of boxes and of the pitch, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """Truncated toward zero."""
    return x.cast("long")


def centre(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return whole((F.col(x1) + F.col(x2)) / 2), whole((F.col(y1) + F.col(y2)) / 2)


def foot(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return whole((F.col(x1) + F.col(x2)) / 2), whole(F.col(y2))


def width(x1="x1", x2="x2") -> Column:
    return F.col(x2) - F.col(x1)


def delta(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """First minus second."""
    return ax - bx, ay - by


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = delta(ax, ay, bx, by)
    return F.sqrt(dx * dx + dy * dy)


def kmh(metres: Column, frames: Column, frame_rate: float) -> Column:
    return metres / (frames / F.lit(frame_rate)) * F.lit(3.6)


def iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) over their union; 0 for empty boxes."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    both = w * h
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def inside_convex(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """On or within a convex polygon whose corners turn so that inside points are to the positive side
    of every edge. Coordinates are truncated first."""
    px, py = whole(x).cast("double"), whole(y).cast("double")
    ok = F.lit(True)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        ok = ok & ((bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0)
    return ok


def inside(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """On or within any simple polygon: crossings of a ray, or a point of an edge."""
    px, py = whole(x).cast("double"), whole(y).cast("double")
    edges = list(zip(corners, [*corners[1:], corners[0]], strict=True))
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in edges:
        cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        on_edge = on_edge | ((cross == 0) & px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by)))
        if ay != by:
            straddles = (F.lit(ay) > py) != (F.lit(by) > py)
            crossings = crossings + (straddles & (px < (bx - ax) * (py - ay) / (by - ay) + ax)).cast("int")
    return on_edge | (crossings % 2 == 1)


def solve_homography(source: Sequence[Sequence[float]], target: Sequence[Sequence[float]]) -> list[float]:
    """The nine numbers, row by row, of the map that takes four points to four points; the last is 1."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    single = np.float32
    found = np.linalg.solve(np.array(single(rows), float), np.array(single(right), float))
    return [*found.tolist(), 1.0]


def project(x: Column, y: Column, h: Sequence) -> tuple[Column, Column]:
    """Through a homography (nine numbers or columns); coordinates are single precision before and after."""
    h = [v if isinstance(v, Column) else F.lit(float(v)) for v in h]
    sx, sy = x.cast("float").cast("double"), y.cast("float").cast("double")
    w = h[6] * sx + h[7] * sy + h[8]
    u, v = (h[0] * sx + h[1] * sy + h[2]) / w, (h[3] * sx + h[4] * sy + h[5]) / w
    return u.cast("float").cast("double"), v.cast("float").cast("double")


def inside_corners(x: Column, y: Column, corners: Column) -> Column:
    """:func:`inside` for a polygon that is data: an array of structs x, y, of any simple polygon."""
    px, py = whole(x).cast("double"), whole(y).cast("double")
    n = F.size(corners)
    ends = F.concat(F.slice(corners, F.lit(2), n - 1), F.slice(corners, F.lit(1), F.lit(1)))
    edges = F.zip_with(corners, ends, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))

    def step(acc: Column, e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"])
        on_edge = (cross == 0) & px.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & py.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
        straddles = (e["ay"] > py) != (e["by"] > py)  # then the edge isn't level
        left = px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]
        crossed = F.when(straddles & left, 1).otherwise(0)
        return F.struct((acc["edge"] | on_edge).alias("edge"), (acc["crossed"] + crossed).alias("crossed"))

    start = F.struct(F.lit(False).alias("edge"), F.lit(0).alias("crossed"))
    return F.when(n >= 3, F.aggregate(edges, start, step, lambda acc: acc["edge"] | (acc["crossed"] % 2 == 1))).otherwise(F.lit(False))


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def _from_square(p: list[Column]) -> list[Column]:
    """The nine numbers of the map that takes the unit square's corners, in order, to four points."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = ((c["x"], c["y"]) for c in p)
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    ax, bx, ay, by = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    det = ax * by - bx * ay
    g, h = F.try_divide(sx * by - bx * sy, det), F.try_divide(ax * sy - sx * ay, det)
    return [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, F.lit(1.0)]


def homography(source: Column, target: Column) -> Column:
    """An array of the nine numbers, row by row, of the map that takes four points to four points (arrays of structs
    x, y); the last number is 1. Null where there aren't four of each, or three of four lie on a line.

    In closed form: from the source to the unit square (the adjugate of the map from it), then to the
    target. Each step is bound by a transform of one element, so that it is worked out once."""
    single = lambda points: F.transform(points, lambda p: F.struct(p["x"].cast("float").cast("double").alias("x"), p["y"].cast("float").cast("double").alias("y")))
    triples = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))

    def flat(points: Column) -> Column:
        out = F.lit(False)
        for i, j, k in triples:
            out = out | F.coalesce(_turn(points[i], points[j], points[k]) == 0, F.lit(True))
        return out

    both = F.array(F.struct(single(source).alias("s"), single(target).alias("t")))
    maps = F.transform(both, lambda b: F.struct(F.array(*_from_square([b["s"][k] for k in range(4)])).alias("s"), F.array(*_from_square([b["t"][k] for k in range(4)])).alias("t"), (flat(b["s"]) | flat(b["t"])).alias("flat")))

    def joined(b: Column) -> Column:
        s, t = [b["s"][k] for k in range(9)], [b["t"][k] for k in range(9)]
        minor = lambda i, j, k, m: s[i] * s[m] - s[j] * s[k]
        back = [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]
        cells = [t[3 * r] * back[c] + t[3 * r + 1] * back[3 + c] + t[3 * r + 2] * back[6 + c] for r in range(3) for c in range(3)]
        return F.when(~b["flat"], F.array(*cells))

    product = F.transform(maps, joined)
    scaled = F.transform(product, lambda h: F.when(h[8] != 0, F.transform(h, lambda v: v / h[8])))
    return F.when((F.size(source) == 4) & (F.size(target) == 4), scaled[0])


def solve_calibrations(calibrations: DataFrame, key: str = "calibration_id") -> DataFrame:
    """The key, h (nine doubles) and src of every calibration of ``calibrations(key, src, dst)``, whose points are arrays
    of four structs x, y. One whose points lie on a line, or that lacks points, has a null h. A repeated key
    counts with its least points."""
    one = calibrations.groupBy(key).agg(F.min(F.struct("src", "dst")).alias("c"))
    return one.select(key, homography(F.col("c.src"), F.col("c.dst")).alias("h"), F.col("c.src").alias("src"))
