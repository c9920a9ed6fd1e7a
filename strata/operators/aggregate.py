"""Histograms, ranges, volumes, region statistics, clustering and measurements."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.grid import per_slice
from strata.registry import operator

NO_DEVIATION = 1e10


@operator("AGG-01")
def histogram(vox: DataFrame, col: str = "tgt", clamp: bool = False, where: Column | None = None) -> DataFrame:
    """(bin, n) of whole numbers 0 to 255, truncated toward 0; with ``clamp`` outliers count in the end bins."""
    rows = vox if where is None else vox.where(where)
    v = F.col(col)
    inside = (v > -1) & (v < 256) if not clamp else F.lit(True)
    bins = F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) if clamp else F.greatest(v, F.lit(0.0))
    inside = (v >= 0) & (v < 256) if not clamp else inside
    return rows.where(inside).groupBy(F.floor(bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@operator("AGG-01")
def out_of_range(vox: DataFrame, col: str = "tgt") -> DataFrame:
    return vox.agg(F.count_if((F.col(col) < 0) | (F.col(col) >= 256)).alias("n"))


def full_histogram(hist: DataFrame) -> DataFrame:
    bins = hist.sparkSession.range(256).select(F.col("id").cast("int").alias("bin"))
    return bins.join(hist, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@operator("AGG-02")
def smooth_histogram(hist: DataFrame, kernel: list[float]) -> DataFrame:
    """Bins convolved with an odd kernel whose weights are renormalised at the ends, rounded."""
    r = len(kernel) // 2
    w = Window.orderBy("bin")
    full = full_histogram(hist)
    value, weight = F.lit(0.0), F.lit(0.0)
    for i, k in enumerate(kernel):
        other = F.lag("n", r - i).over(w) if i < r else F.lead("n", i - r).over(w) if i > r else F.col("n")
        value = value + F.coalesce(other * float(k), F.lit(0.0))
        weight = weight + F.when(other.isNotNull(), F.lit(float(k))).otherwise(0.0)
    return full.select("bin", F.floor(value / weight + 0.5).cast("long").alias("n"))


@operator("AGG-03")
def modal_cuts(hist: DataFrame, least: int, ratio: float) -> list[int]:
    """Cuts at the valleys of a histogram of 256 bins."""
    from strata.operators.kernels import valleys

    rows = full_histogram(hist).orderBy("bin").collect()  # 256 rows
    return valleys(np.array([r["n"] for r in rows]), least, ratio)


@operator("AGG-04")
def compact_histogram(hist: DataFrame) -> DataFrame:
    """(bin, n, new): bins that hold something move together."""
    return hist.where("n > 0").select("bin", "n", (F.row_number().over(Window.orderBy("bin")) - 1).cast("int").alias("new"))


@operator("AGG-05")
def value_range(vox: DataFrame, col: str = "tgt", by_slice: bool = False) -> DataFrame:
    rows = vox.groupBy("z") if by_slice else vox.groupBy()
    return rows.agg(F.min(col).alias("low"), F.max(col).alias("high"))


@operator("AGG-06")
def mode_range(vox: DataFrame, col: str, modes: DataFrame, as_coded: bool = False) -> DataFrame:
    """Range over the slices whose mode is 1; as coded, the high end is never below 0 and nothing gives 255 and 0."""
    rows = vox.join(F.broadcast(modes.where("mode = 1").select("z")), "z", "left_semi").agg(F.min(col).alias("low"), F.max(col).alias("high"))
    return rows.select(F.coalesce("low", F.lit(255.0)).alias("low"), F.greatest("high", F.lit(0.0)).alias("high")) if as_coded else rows


@operator("AGG-07")
def pixel_count(vox: DataFrame, col: str, value: float) -> DataFrame:
    return vox.groupBy("z").agg(F.count_if(F.col(col) == value).alias("n"))


@operator("AGG-08")
def volumes(vox: DataFrame, dx: float, dy: float, dz: float, col: str = "tis") -> DataFrame:
    return vox.groupBy(col).agg(F.count("*").alias("n"), (F.count("*") * (float(dx) * dy * dz)).alias("volume"))


@operator("AGG-09")
def extents(vox: DataFrame, by_slice: bool = False) -> DataFrame:
    keys = ["z", "tis"] if by_slice else ["tis"]
    axes = ["x", "y"] if by_slice else ["x", "y", "z"]
    return vox.where("tis > 0").groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in axes for f, n in ((F.min, "min"), (F.max, "max"))])


def statistics(col: str) -> list[Column]:
    """Mean, sample deviation (1e10 of a single value), least and largest."""
    return [F.avg(col).alias("mean"), F.when(F.count(col) == 1, F.lit(NO_DEVIATION)).otherwise(F.stddev_samp(col)).alias("stddev"), F.min(col).alias("least"), F.max(col).alias("largest")]


@operator("AGG-10")
def window_features(vox: DataFrame, x0: int, y0: int, x1: int, y1: int, col: str = "src") -> DataFrame:
    inside = F.col("x").between(min(x0, x1), max(x0, x1)) & F.col("y").between(min(y0, y1), max(y0, y1))
    return vox.where(inside).groupBy("z").agg(*statistics(col))


@operator("AGG-11")
def mask_features(vox: DataFrame, mask: Column, col: str = "src") -> DataFrame:
    return vox.where(mask).groupBy("z").agg(*statistics(col))


@operator("AGG-12")
def component_sizes(vox: DataFrame, comp: str = "comp") -> DataFrame:
    """(tis, comp, n, total): size of every component and of its label."""
    sizes = vox.groupBy("tis", comp).agg(F.count("*").alias("n"))
    return sizes.withColumn("total", F.sum("n").over(Window.partitionBy("tis")))


@operator("AGG-13")
def at_boundary(vox: DataFrame, col: str, value: float, h: int, w: int, ends: tuple[int, int] | None = None) -> DataFrame:
    """Whether a slice (with ``ends`` also: the volume's first and last) has the value on its border."""
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == w - 1) | (F.col("y") == h - 1)
    found = F.coalesce(F.bool_or(border & (F.col(col) == value)), F.lit(False)).alias("found")
    if ends is None:
        return vox.groupBy("z").agg(found)
    border = border | F.col("z").isin(list(ends))
    return vox.agg(F.coalesce(F.bool_or(border & (F.col(col) == value)), F.lit(False)).alias("found"))


def length(*parts: Column) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p * p
    return F.sqrt(total)


@operator("AGG-14")
def distances(pairs: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    """``distance`` and ``thickness`` of (x0, y0, z0)-(x1, y1, z1): thickness counts the end voxels on every axis that
    differs, and is one voxel along x when none does."""
    d = [F.abs(F.col(f"{a}1") - F.col(f"{a}0")) for a in "xyz"]
    s = (float(dx), float(dy), float(dz))
    same = (d[0] == 0) & (d[1] == 0) & (d[2] == 0)
    thick = [F.when(v > 0, v + 1).otherwise(F.when(same, F.lit(1 if i == 0 else 0)).otherwise(0)) * k for i, (v, k) in enumerate(zip(d, s, strict=True))]
    return pairs.withColumns({"distance": length(*[v * k for v, k in zip(d, s, strict=True)]), "thickness": length(*thick)})


@operator("AGG-14")
def angles(triples: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    """``angle`` in degrees at the middle of three points; 0 if two of them are one."""
    s = dict(zip("xyz", (float(dx), float(dy), float(dz)), strict=True))
    u = [(F.col(f"{a}0") - F.col(f"{a}1")) * k for a, k in s.items()]
    v = [(F.col(f"{a}2") - F.col(f"{a}1")) * k for a, k in s.items()]
    dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    size = length(*u) * length(*v)
    cos = F.least(F.greatest(F.try_divide(dot, size), F.lit(-1.0)), F.lit(1.0))
    return triples.withColumn("angle", F.when(size == 0, 0.0).otherwise(F.degrees(F.acos(cos))))


@operator("AGG-15")
def object_features(vox: DataFrame, comp: str = "comp") -> DataFrame:
    """Centre, size, boundary length, box, equivalent radius, flatness and roundness of every component of a slice."""
    w = {"x": Window.partitionBy("z", "y").orderBy("x"), "y": Window.partitionBy("z", "x").orderBy("y")}
    edge = F.lit(0)
    for a, win in w.items():
        for f, step in ((F.lag, -1), (F.lead, 1)):
            same = (f(comp).over(win) == F.col(comp)) & (f(a).over(win) == F.col(a) + step)
            edge = edge + F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    rows = vox.withColumn("__edge", edge).where(F.col(comp).isNotNull()).groupBy("z", comp)
    out = rows.agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("size"), F.sum("__edge").alias("perimeter"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"),
    )
    root = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("vxy", 2))
    mean = (F.col("vx") + F.col("vy")) / 2
    return out.withColumns(
        {
            "radius": F.sqrt(F.col("size") / np.pi),
            "roundness": 4 * np.pi * F.col("size") / F.pow("perimeter", 2),
            "flatness": F.sqrt(F.try_divide(mean + root, F.greatest(mean - root, F.lit(0.0)))),
            "diameter": length(F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1),
        }
    )


@operator("AGG-16")
def softmax(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """exp(-score) over the sum of its group; a group of one keeps exp(-score), and what isn't a number is 0."""
    w = Window.partitionBy(*keys)
    e = F.exp(-F.col(score))
    value = F.when(F.count("*").over(w) == 1, e).otherwise(F.try_divide(e, F.sum(e).over(w)))
    return rows.withColumn("p", F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)))


def start_centers(low: list[float], high: list[float], k: int) -> list[list[float]]:
    """Evenly spaced from the largest down to the least value of every dimension."""
    return [[h - (h - lo) * (i / (k - 1) if k > 1 else 0.5) for lo, h in zip(low, high, strict=True)] for i in range(k)]


def nearest_center(features: list[str], centers: list[list[float]], weights: list[float]) -> tuple[Column, Column]:
    """(class, squared weighted distance) of the nearest centre; of equally near ones the first."""
    each = []
    for j, c in enumerate(centers):
        d = F.lit(0.0)
        for f, v, w in zip(features, c, weights, strict=True):
            d = d + (F.col(f) - float(v)) * (F.col(f) - float(v)) * float(w)
        each.append(F.struct(d.alias("d"), F.lit(j).alias("j")))
    best = F.array_min(F.array(*each))
    return best["j"], best["d"]


@operator("AGG-17")
def kmeans(train: DataFrame, features: list[str], k: int, weights: list[float] | None = None, rounds: int = 20, converged: int = 0, centers: list[list[float]] | None = None) -> list[list[float]]:
    """Lloyd's rounds from given or evenly spaced centres. An empty class keeps its centre; it ends when no more than
    ``converged`` rows change class. Only k centres come to the driver in a round."""
    weights = weights or [1.0] * len(features)
    total = sum(weights)
    weights = [w / total for w in weights] if total else [1 / len(features)] * len(features)
    if centers is None:
        r = train.agg(*[F.min(f).alias(f"l{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"h{i}") for i, f in enumerate(features)]).first()
        centers = start_centers([r[f"l{i}"] for i in range(len(features))], [r[f"h{i}"] for i in range(len(features))], k)
    before = None
    for _ in range(rounds):
        now = train.withColumn("__c", nearest_center(features, centers, weights)[0])
        changed = F.lit(True) if before is None else nearest_center(features, before, weights)[0] != F.col("__c")
        got = now.groupBy("__c").agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], F.count_if(changed).alias("moved")).collect()  # k rows
        if before is not None and sum(r["moved"] for r in got) <= converged:
            break
        before, centers = centers, [list(c) for c in centers]
        for r in got:
            centers[r["__c"]] = [r[f"m{i}"] for i in range(len(features))]
    return centers


@operator("AGG-17")
def apply_centers(vox: DataFrame, features: list[str], centers: list[list[float]], weights: list[float] | None = None) -> DataFrame:
    """The target is the class times 255 / (k - 1)."""
    c, _ = nearest_center(features, centers, weights or [1.0] * len(features))
    return vox.withColumn("tgt", c * (255.0 / max(len(centers) - 1, 1)))


@operator("AGG-20")
def classify(vox: DataFrame, features: list[str], centers: list[list[float]], weights: list[float], most: float) -> DataFrame:
    """255 * (class + 1) / n for the nearest centre if it is nearer than ``most``, else 0."""
    c, d = nearest_center(features, centers, weights)
    return vox.withColumn("tgt", F.when(d < most * most, (c + 1) * (255.0 / len(centers))).otherwise(0.0))


@operator("AGG-18")
def em(train: DataFrame, features: list[str], k: int, index: Column, rounds: int = 10) -> list[tuple[float, list[float], float]]:
    """(amplitude, mean, variance) of k round Gaussians; row i starts in class i mod k. k rows a round come back."""
    dims = len(features)
    start = (F.pmod(index, F.lit(k))).cast("int")
    share = [F.when(start == j, 1.0).otherwise(0.0) for j in range(k)]
    model: list[tuple[float, list[float], float]] = []
    for _ in range(rounds):
        if model:
            dense = []
            for a, m, v in model:
                d = F.lit(0.0)
                for f, c in zip(features, m, strict=True):
                    d = d + (F.col(f) - float(c)) * (F.col(f) - float(c))
                dense.append(F.lit(float(a / max(v, 1e-12) ** (dims / 2))) * F.exp(-d / (2 * max(v, 1e-12))))
            total = sum(dense[1:], dense[0])
            share = [F.coalesce(F.try_divide(d, total), F.lit(1.0 / k)) for d in dense]
        aggs = [F.count("*").alias("n")]
        for j, s in enumerate(share):
            aggs.append(F.sum(s).alias(f"s{j}"))
            for i, f in enumerate(features):
                aggs += [F.sum(s * F.col(f)).alias(f"m{j}_{i}"), F.sum(s * F.col(f) * F.col(f)).alias(f"q{j}_{i}")]
        r = train.agg(*aggs).first()
        new = []
        for j in range(k):
            s = max(r[f"s{j}"], 1e-12)
            m = [r[f"m{j}_{i}"] / s for i in range(dims)]
            v = sum(r[f"q{j}_{i}"] / s - m[i] ** 2 for i in range(dims)) / dims
            new.append((r[f"s{j}"] / max(r["n"], 1), m, max(v, 1e-9)))
        model = new
    return model


@operator("AGG-18")
def apply_em(vox: DataFrame, features: list[str], model: list[tuple[float, list[float], float]]) -> DataFrame:
    """The likeliest class (amplitudes aside) times 255 / (k - 1); of the rows given, not of those trained on."""
    each = []
    for j, (_, m, v) in enumerate(model):
        d = F.lit(0.0)
        for f, c in zip(features, m, strict=True):
            d = d + (F.col(f) - float(c)) * (F.col(f) - float(c))
        each.append(F.struct((d / (2 * v) + 0.5 * len(features) * float(np.log(v))).alias("d"), F.lit(j).alias("j")))
    return vox.withColumn("tgt", F.array_min(F.array(*each))["j"] * (255.0 / max(len(model) - 1, 1)))


@operator("AGG-19")
def gamma_index(vox: DataFrame, centers: list[float], radius: int, distance: float, difference: float) -> DataFrame:
    """Class of the least (step / distance)^2 + (value - centre)^2 / difference^2 within the radius, * 255 / (k - 1)."""

    def kernel(src: np.ndarray) -> np.ndarray:
        best = np.full((len(centers), *src.shape), np.inf)
        wide = np.pad(src, radius, constant_values=np.inf)
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                part = wide[radius + dy : radius + dy + src.shape[0], radius + dx : radius + dx + src.shape[1]]
                for j, c in enumerate(centers):
                    best[j] = np.minimum(best[j], (dy * dy + dx * dx) / distance**2 + (part - c) ** 2 / difference**2)
        return best.argmin(axis=0) * 255.0 / max(len(centers) - 1, 1)

    return per_slice(vox, kernel, ["src"])


@operator("AGG-21")
def density_threshold(vox: DataFrame, value: float, radius: int, percent: float) -> DataFrame:
    """255 where at least so many percent of the window (edges repeated) reach the value."""
    from strata.operators.kernels import box_mean

    return per_slice(vox, lambda a: np.where(box_mean((a >= value).astype(float), radius) >= percent / 100 - 1e-12, 255.0, 0.0), ["src"])


@operator("AGG-22")
def label_mask(vox: DataFrame, label: int) -> DataFrame:
    return vox.select("z", "y", "x", F.when(F.col("tis") == label, 255.0).otherwise(0.0).alias("value"))


Kernel = Callable[[np.ndarray], np.ndarray]
