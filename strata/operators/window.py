"""Neighbourhood operators. One axis at a time they are window functions; wider ones run a kernel on each slice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.grid import per_slice, per_volume
from strata.operators import kernels as K
from strata.registry import operator


def along(axis: str) -> Window:
    """A line of voxels along an axis."""
    return Window.partitionBy(*[c for c in ("z", "y", "x") if c != axis]).orderBy(axis)


def at(col: str | Column, axis: str, step: int) -> Column:
    """The value ``step`` voxels on along an axis; null past the end of the line. Lines have no holes."""
    w = along(axis)
    return F.lead(col, step).over(w) if step >= 0 else F.lag(col, -step).over(w)


@operator("WIN-01")
def convolve_line(vox: DataFrame, kernel: list[float], axis: str, col: str = "src") -> DataFrame:
    """Correlation along an axis; 0 where the kernel leaves the grid."""
    r = len(kernel) // 2
    total = sum((at(col, axis, i - r) * float(k) for i, k in enumerate(kernel)), F.lit(0.0))
    return vox.withColumn("tgt", F.coalesce(total, F.lit(0.0)))


@operator("WIN-01")
def convolve(vox: DataFrame, kernel: list[list[float]], col: str = "src") -> DataFrame:
    k = np.array(kernel, dtype=float)
    return per_slice(vox, lambda a: K.correlate(a, k), [col])


@operator("WIN-02")
def gauss_kernel(sigma: float, n: int, as_coded: bool = False) -> list[float] | None:
    return K.gauss_taps(sigma, n, as_coded).tolist() if n % 2 else None


@operator("WIN-02")
def laplace_kernel() -> list[float]:
    return [1.0, -2.0, 1.0]


@operator("WIN-03")
def gaussian(vox: DataFrame, sigma: float) -> DataFrame:
    if sigma <= 0.66:
        return vox.withColumn("tgt", F.col("src"))
    k = gauss_kernel(sigma, int(3 * sigma) | 1)
    return convolve_line(convolve_line(vox, k, "x"), k, "y", "tgt")


@operator("WIN-04")
def average(vox: DataFrame, n: int) -> DataFrame:
    k = [1.0 / n] * n
    return convolve_line(convolve_line(vox, k, "x"), k, "y", "tgt")


@operator("WIN-05")
def median(vox: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Median of the 3x3 window's voxels; the border, that of ``shape`` if given, keeps the source."""
    return per_slice(vox, K.median3, ["src"], shape=shape)


@operator("WIN-05")
def interquartile(vox: DataFrame, shape: tuple[int, int] | None = None) -> DataFrame:
    """Null where a window has fewer than eight voxels."""
    return per_slice(vox, K.interquartile3, ["src"], shape=shape)


@operator("WIN-06")
def sigma_filter(vox: DataFrame, sigma: float, nx: int, ny: int, shape: tuple[int, int] | None = None) -> DataFrame:
    return per_slice(vox, lambda a, t: K.sigma_filter(a, t, sigma, nx, ny), ["src", "tgt"], shape=shape)


@operator("WIN-07")
def moment(vox: DataFrame, n: int = 3, p: int = 2, sigma: float | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    return per_slice(vox, lambda a: K.moment(a, n, p, sigma), ["src"], shape=shape)


@operator("WIN-08")
def sobel(vox: DataFrame, finer: bool = False) -> DataFrame:
    """|gx| + |gy|, or with ``finer`` the gradient's length; both parts stay as gx and gy. Borders are 0."""
    out = vox
    for name, (one, two) in {"gx": ("y", "x"), "gy": ("x", "y")}.items():
        smooth = at("src", one, -1) + F.col("src") * 2 + at("src", one, 1)
        out = out.withColumn("__s", smooth).withColumn(name, F.coalesce(at("__s", two, 1) - at("__s", two, -1), F.lit(0.0)))
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")) if finer else F.abs("gx") + F.abs("gy")
    return out.withColumn("tgt", size).drop("__s")


@operator("WIN-09")
def laplacian(vox: DataFrame, product: bool = False) -> DataFrame:
    """3x3 weights (-1, -2, 12) / 12; ``product``: 1, -2, 1 along rows and then along columns."""
    if product:
        return convolve_line(convolve_line(vox, laplace_kernel(), "x"), laplace_kernel(), "y", "tgt")
    line = (at("src", "x", -1) + at("src", "x", 1)).alias("l")
    out = vox.withColumn("__l", line)
    corner = at("__l", "y", -1) + at("__l", "y", 1)
    cross = F.col("__l") + at("src", "y", -1) + at("src", "y", 1)
    return out.withColumn("tgt", F.coalesce((F.col("src") * 12 - cross * 2 - corner) / 12, F.lit(0.0))).drop("__l")


@operator("WIN-10")
def gauss_line(vox: DataFrame, sigma: float) -> DataFrame:
    return gaussian(vox, sigma).withColumn("tgt", F.col("tgt") - F.col("src"))


@operator("WIN-10")
def gauss_sharpen(vox: DataFrame, sigma: float, as_coded: bool = False) -> DataFrame:
    """The source and its difference from the blur; as coded, the blur itself."""
    blurred = gaussian(vox, sigma)
    return blurred if as_coded else blurred.withColumn("tgt", F.col("src") * 2 - F.col("tgt"))


@operator("WIN-11")
def directions(vox: DataFrame) -> DataFrame:
    return sobel(vox).withColumn("tgt", F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0)))


@operator("WIN-11")
def canny(vox: DataFrame, sigma: float, low: float, high: float) -> DataFrame:
    return per_slice(vox, lambda a: K.canny_lines(a, sigma, low, high), ["src"])


@operator("WIN-12")
def zero_crossings(vox: DataFrame, least: float | None = None) -> DataFrame:
    """255, and -1 at crossings: on the side that isn't positive, or with a least difference on the positive side."""
    hit = F.lit(False)
    for axis in ("x", "y"):
        for step in (-1, 1):
            o, v = at("src", axis, step), F.col("src")
            one = ((o * v <= 0) & (v <= 0)) if least is None else ((o * v < 0) & (F.abs(o - v) > least) & (v > 0))
            hit = hit | F.coalesce(one, F.lit(False))
    return vox.withColumn("tgt", F.when(hit, -1.0).otherwise(255.0))


@operator("WIN-13")
def mark_border(vox: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for axis in ("x", "y"):
        for step in (-1, 1):
            hit = hit | F.coalesce(F.col("tgt") > at("tgt", axis, step), F.lit(False))
    return vox.withColumn("tgt", F.when(hit, -1.0).otherwise(F.col("tgt")))


@operator("WIN-14")
def erosion(vox: DataFrame, n: int = 1, col: str = "tgt", only_zero: bool = False) -> DataFrame:
    """n passes: a voxel with a 4-neighbour of another value (or only: 0) becomes 0. One shuffle for each axis."""
    for _ in range(n):
        gone = F.lit(False)
        for axis in ("x", "y"):
            for step in (-1, 1):
                o = at(col, axis, step)
                gone = gone | F.coalesce(o == 0 if only_zero else o != F.col(col), F.lit(False))
        vox = vox.withColumn("__gone", gone).withColumn(col, F.when(F.col("__gone"), F.lit(0).cast(dict(vox.dtypes)[col])).otherwise(F.col(col))).drop("__gone")
    return vox


@operator("WIN-15")
def dilation(vox: DataFrame, n: int = 1, col: str = "tgt", full: bool = False) -> DataFrame:
    return per_slice(vox, lambda a: K.dilate(a, n, full), [col], col)


@operator("WIN-16")
def closing(vox: DataFrame, n: int = 1, col: str = "tgt", full: bool = False) -> DataFrame:
    return per_slice(vox, lambda a: K.close(a, n, full), [col], col)


@operator("WIN-16")
def opening(vox: DataFrame, n: int = 1, col: str = "tgt", full: bool = False) -> DataFrame:
    return per_slice(vox, lambda a: K.open_(a, n, full), [col], col)


@operator("WIN-17")
def morphology(vox: DataFrame, op: str, radius: float, spacing: tuple[float, float, float] | None = None, three: bool = False) -> DataFrame:
    """Ball of a radius in voxels, or in millimetres if a spacing (z, y, x) is given; in slices or in the volume."""
    s = spacing or (1.0, 1.0, 1.0)
    r = tuple(radius / v for v in s)
    return per_volume(vox, lambda a: K.morph(a, op, r), ["tgt"]) if three else per_slice(vox, lambda a: K.morph(a, op, r[1:]), ["tgt"])


@operator("WIN-18")
def anisotropic_diffusion(vox: DataFrame, dt: float, n: int, k: float, restraint: float = 0.0) -> DataFrame:
    return per_slice(vox, lambda s, t: K.diffuse(s, t, dt, n, k, restraint), ["src", "tgt"])


@operator("WIN-19")
def mode_filter(vox: DataFrame, n: int) -> DataFrame:
    return per_slice(vox, lambda t: K.mode_filter(t, n), ["tis"], "tis")


@operator("WIN-20")
def smooth_labels(vox: DataFrame, sigma: float, locked: list[int] | None = None) -> DataFrame:
    return per_slice(vox, lambda t: K.smooth_labels(t, sigma, locked), ["tis"], "tis")


@operator("WIN-21")
def smooth_steps(vox: DataFrame, n: int) -> DataFrame:
    """For each (y, x) the label with most binomial votes along z, of equal ones the lowest; ends are extended, lines
    shorter than the mask stay. Lines are short: a volume's slices."""
    weights = np.array([1.0])
    for _ in range(n - 1):
        weights = np.convolve(weights, [1.0, 1.0])
    r = n // 2
    line = Window.partitionBy("y", "x")
    taps = F.array(*[F.struct(F.coalesce(at("tis", "z", i - r), F.first("tis").over(line.orderBy("z").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if i < r else F.last("tis").over(line.orderBy("z").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("t"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    votes = vox.withColumns({"__taps": taps, "__n": F.count("*").over(line)})
    sums = F.transform(F.array_distinct(F.transform("__taps", lambda s: s["t"])), lambda t: F.struct((-F.aggregate(F.filter("__taps", lambda s: s["t"] == t), F.lit(0.0), lambda a, s: a + s["w"])).alias("v"), t.alias("t")))
    return votes.withColumn("tis", F.when(F.col("__n") < n, F.col("tis")).otherwise(F.array_min(sums)["t"])).drop("__taps", "__n")


@operator("WIN-22")
def vote_labels(vox: DataFrame, foreground: int, background: int = 0, birth: int = 1, majority: int = 1, rounds: int = 10) -> DataFrame:
    return per_slice(vox, lambda t: K.vote(t, foreground, background, birth, majority, rounds), ["tis"], "tis")


@operator("WIN-23")
def unwrap(vox: DataFrame, ratio: float, span: float, shift: float = 0.0) -> DataFrame:
    return per_slice(vox, lambda a: K.unwrap(a, ratio, span, shift), ["src"])


@operator("WIN-23")
def unwrap_line(rows: DataFrame, keys: list[str], order: list[str], value: str, ratio: float, span: float) -> DataFrame:
    """Running correction of jumps along ordered rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = F.col(value) - F.lag(value).over(w)
    jump = rows.withColumn("__j", F.when(d > ratio * span, -float(span)).when(d < -ratio * span, float(span)).otherwise(0.0))
    return jump.withColumn("unwrapped", F.col(value) + F.sum("__j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__j")


@operator("WIN-24")
def interpolate(vox: DataFrame, z0: int, z1: int, col: str = "tgt") -> DataFrame:
    """(z, y, x, value) of the slices between two, linear in z."""
    a = vox.where(F.col("z") == z0).select("y", "x", F.col(col).alias("a"))
    b = vox.where(F.col("z") == z1).select("y", "x", F.col(col).alias("b"))
    zs = F.explode(F.sequence(F.lit(z0 + 1), F.lit(z1 - 1))) if z1 - z0 > 1 else F.explode(F.array().cast("array<int>"))
    return a.join(b, ["y", "x"]).withColumn("z", zs).select("z", "y", "x", (F.col("a") + (F.col("b") - F.col("a")) / (z1 - z0) * (F.col("z") - z0)).alias("value"))


@operator("WIN-24")
def extrapolate(vox: DataFrame, z0: int, z1: int, z: int, col: str = "tgt") -> DataFrame:
    a = vox.where(F.col("z") == z0).select("y", "x", F.col(col).alias("a"))
    b = vox.where(F.col("z") == z1).select("y", "x", F.col(col).alias("b"))
    return a.join(b, ["y", "x"]).select(F.lit(z).alias("z"), "y", "x", (F.col("a") + (F.col("b") - F.col("a")) / (z1 - z0) * (z - z0)).alias("value"))


def _between(vox: DataFrame, z0: int, z1: int, col: str, value: float, make) -> DataFrame:
    """(z, y, x, value): masks between those of two slices; both slices meet in one task."""
    import pandas as pd

    from strata.grid import image

    pair = vox.where(F.col("z").isin(z0, z1)).select("z", "y", "x", F.col(col))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        masks = [image(pdf[pdf["z"] == z], col) for z in (z0, z1)]
        masks = [m == value if value is not None else m > 0 for m in masks]
        out = []
        for k, m in enumerate(make(masks[0], masks[1], z1 - z0 - 1), 1):
            y, x = np.mgrid[0 : m.shape[0], 0 : m.shape[1]]
            out.append(pd.DataFrame({"z": np.full(m.size, z0 + k, np.int32), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "value": np.where(m.ravel(), 255.0, 0.0)}))
        return pd.concat(out) if out else pd.DataFrame({"z": [], "y": [], "x": [], "value": []})

    return pair.groupBy().applyInPandas(run, "z int, y int, x int, value double")


@operator("WIN-25")
def shape_between(vox: DataFrame, z0: int, z1: int, col: str = "tgt", value: float | None = None) -> DataFrame:
    return _between(vox, z0, z1, col, value, K.between)


@operator("WIN-26")
def median_sets_between(vox: DataFrame, z0: int, z1: int, col: str = "tgt", value: float | None = None) -> DataFrame:
    def halves(a: np.ndarray, b: np.ndarray, n: int) -> list[np.ndarray]:
        if n <= 0:
            return []
        m = K.median_set(a, b)
        k = n // 2
        return [*halves(a, m, k), m, *halves(m, b, n - 1 - k)]

    return _between(vox, z0, z1, col, value, halves)


@operator("WIN-27")
def connected_shape_between(vox: DataFrame, z0: int, z1: int, col: str = "tgt", value: float | None = None) -> DataFrame:
    return _between(vox, z0, z1, col, value, K.connected_between)
