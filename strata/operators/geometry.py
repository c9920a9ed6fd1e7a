"""Contours and surfaces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.grid import image
from strata.operators import kernels as K
from strata.registry import operator

POINTS = "array<struct<x:int,y:int>>"


def trace(on: np.ndarray) -> list[np.ndarray]:
    """Closed lines (y, x) along the pixels just inside the border of each component, turning clockwise."""
    ring = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]
    a = np.pad(on, 1)
    comp = K.components(a.astype(int), True, a)
    out = []
    for c in range(comp.max() + 1):
        part = comp == c
        start = tuple(np.argwhere(part)[0].tolist())
        line, p, back = [start], start, 7
        first = None
        while True:
            for i in range(1, 9):
                d = (back + i) % 8
                q = (p[0] + ring[d][0], p[1] + ring[d][1])
                if part[q]:
                    break
            else:
                break
            if first is None:
                first = (p, q)
            elif (p, q) == first:
                line.pop()
                break
            line.append(q)
            back, p = (d + 5) % 8 if d % 2 == 0 else (d + 6) % 8, q
        out.append(np.array(line) - 1)
    return out


@operator("GEOM-01")
def contours(vox: DataFrame, least: int = 1, col: str = "tis") -> DataFrame:
    """(z, tissue, outer, line_no, points) of every label: outer lines round components, inner ones round their holes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, rows = image(pdf, col), []
        for t in np.unique(a[a != 0]).tolist():
            on = a == t
            holes = ~on & ~K.exterior(~on)
            for outer, mask in ((True, on), (False, holes)):
                lines = [p for p in trace(mask) if len(p) >= least] if mask.any() else []
                rows += [(int(pdf["z"].iloc[0]), int(t), outer, i, [{"x": int(x), "y": int(y)} for y, x in p]) for i, p in enumerate(lines)]
        return pd.DataFrame(rows, columns=["z", "tissue", "outer", "line_no", "points"])

    return vox.select("z", "y", "x", col).groupBy("z").applyInPandas(run, f"z int, tissue int, outer boolean, line_no int, points {POINTS}")


def simplified(points: list[tuple[float, float]], epsilon: float) -> list[int]:
    """Douglas-Peucker: indices of points kept; a point farther than epsilon from the chord splits it. A chord of
    coinciding ends measures the distance to that point."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    p = np.array(points, dtype=float)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord, rest = p[b] - p[a], p[a + 1 : b] - p[a]
        size = np.hypot(*chord)
        d = np.hypot(rest[:, 0], rest[:, 1]) if size == 0 else np.abs(chord[0] * rest[:, 1] - chord[1] * rest[:, 0]) / size
        i = int(d.argmax())
        if d[i] > epsilon:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return sorted(keep) if points else []


@operator("GEOM-02")
def douglas_peucker(lines: DataFrame, epsilon: float) -> DataFrame:
    @F.pandas_udf(POINTS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ps: [ps[i] for i in simplified([(q["x"], q["y"]) for q in ps], epsilon)])

    return lines.withColumn("points", run("points"))


@operator("GEOM-03")
def thin_points(lines: DataFrame, d: float) -> DataFrame:
    """Points nearer than d to the last kept one go; the first stays."""

    def step(kept: Column, p: Column) -> Column:
        q = F.element_at(kept, -1)
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        return F.when(F.size(kept) == 0, F.array(p)).when(dx * dx + dy * dy < d * d, kept).otherwise(F.concat(kept, F.array(p)))

    kept = F.aggregate("points", F.array().cast(dict(lines.dtypes)["points"]), step)
    return lines.withColumn("points", kept)


@operator("GEOM-04")
def shift_contours(lines: DataFrame, dx: int, dy: int) -> DataFrame:
    moved = F.transform("points", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    return lines.withColumn("points", moved.cast(dict(lines.dtypes)["points"]))


@operator("GEOM-04")
def extruded(lines: DataFrame, thickness: float, ends: tuple[float, float] | None = None) -> DataFrame:
    """Slice thickness, of the first and last slice by its own value if given."""
    w = Window.partitionBy()
    out = F.lit(float(thickness))
    if ends:
        out = F.when(F.col("z") == F.min("z").over(w), float(ends[0])).when(F.col("z") == F.max("z").over(w), float(ends[1])).otherwise(out)
    return lines.withColumn("thickness", out)


def inside_polygon(polygon: list[tuple[float, float]], h: int, w: int, hole: bool = False) -> np.ndarray:
    """Pixels whose centre is inside by the even-odd rule, or which an edge passes."""
    out = np.zeros((h, w), dtype=bool)
    p = np.array(polygon, dtype=float)
    if not len(p):
        return out
    x0, x1 = p[:, 0], np.roll(p[:, 0], -1)
    y0, y1 = p[:, 1], np.roll(p[:, 1], -1)
    for y in range(max(0, int(np.floor(p[:, 1].min()))), min(h, int(np.ceil(p[:, 1].max())) + 1)):
        hit = (y0 <= y) != (y1 <= y)
        xs = np.sort(x0[hit] + (y - y0[hit]) * (x1[hit] - x0[hit]) / (y1[hit] - y0[hit]))
        for a, b in zip(xs[0::2], xs[1::2], strict=True):
            out[y, max(0, int(np.ceil(a))) : max(0, min(w, int(np.floor(b)) + 1))] = True
    if not hole:
        for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
            n = int(np.abs(b - a).max().round())
            at = np.round(a + (b - a) * np.linspace(0, 1, n + 1)[:, None]).astype(int)
            ok = (at[:, 0] >= 0) & (at[:, 0] < w) & (at[:, 1] >= 0) & (at[:, 1] < h)
            out[at[ok, 1], at[ok, 0]] = True
    return out


@operator("GEOM-05", "SCAN-17")
def rasterise(lines: DataFrame, h: int, w: int) -> DataFrame:
    """(z, tissue, y, x) inside the closed lines of a slice and tissue; lines in lines are holes (even and odd)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((h, w), dtype=bool)
        for ps in pdf["points"]:
            m ^= inside_polygon([(q["x"], q["y"]) for q in ps], h, w)
        y, x = np.nonzero(m)
        return pd.DataFrame({"z": np.full(len(y), pdf["z"].iloc[0]), "tissue": np.full(len(y), pdf["tissue"].iloc[0]), "y": y, "x": x})

    return lines.select("z", "tissue", "points").groupBy("z", "tissue").applyInPandas(run, "z int, tissue int, y int, x int")


@operator("GEOM-06")
def correct_outline(vox: DataFrame, z: int, value: float, drawn: list[tuple[int, int]], col: str = "tgt") -> DataFrame:
    """The drawn line (x, y) replaces the part of the outline between its ends: the side of the region that it encloses
    with the shorter stretch of the old outline changes."""
    from strata.grid import per_slice

    def kernel(zs: np.ndarray, a: np.ndarray) -> np.ndarray:
        if zs.flat[0] != z or not (a == value).any():
            return a
        on = a == value
        lines = trace(on)
        line = min(lines, key=lambda p: np.abs(p - np.array(drawn[0])[::-1]).sum(axis=1).min())
        i, j = (int(np.abs(line - np.array(q)[::-1]).sum(axis=1).argmin()) for q in (drawn[0], drawn[-1]))
        lo, hi = sorted((i, j))
        short = line[lo : hi + 1] if hi - lo <= len(line) - (hi - lo) else np.concatenate([line[hi:], line[: lo + 1]])
        poly = [(int(x), int(y)) for y, x in short]
        ends = drawn if (abs(poly[-1][0] - drawn[0][0]) + abs(poly[-1][1] - drawn[0][1])) <= (abs(poly[-1][0] - drawn[-1][0]) + abs(poly[-1][1] - drawn[-1][1])) else drawn[::-1]
        area = inside_polygon(poly + list(ends), *a.shape)
        mostly_in = (on & area).sum() * 2 > area.sum()
        new = on & ~area if mostly_in else on | area
        for x, y in drawn:
            if 0 <= y < a.shape[0] and 0 <= x < a.shape[1]:
                new[y, x] = True
        return np.where(new, value, np.where(on, 0, a))

    return per_slice(vox.withColumn("__z", F.col("z").cast("double")), kernel, ["__z", col], col).drop("__z")


@operator("GEOM-07")
def surfaces(vox: DataFrame, dx: float = 1.0, dy: float = 1.0, dz: float = 1.0) -> DataFrame:
    """(tissue, axis, side, x, y, z, area): faces between a label and what isn't it, two triangles each."""
    area = {"x": dy * dz, "y": dx * dz, "z": dx * dy}
    out = None
    for axis in ("x", "y", "z"):
        w = Window.partitionBy(*[c for c in ("z", "y", "x") if c != axis]).orderBy(axis)
        for side, f in ((-1, F.lag), (1, F.lead)):
            near = (f(axis).over(w) == F.col(axis) + side) & (f("tis").over(w) == F.col("tis"))
            faces = vox.withColumn("__same", F.coalesce(near, F.lit(False))).where("tis > 0 and not __same")
            rows = faces.select(F.col("tis").alias("tissue"), F.lit(axis).alias("axis"), F.lit(side).alias("side"), "x", "y", "z", F.lit(float(area[axis])).alias("area"))
            out = rows if out is None else out.unionByName(rows)
    return out


@operator("GEOM-08")
def add_contours(lines: DataFrame, new: DataFrame) -> DataFrame:
    return lines.unionByName(new)
