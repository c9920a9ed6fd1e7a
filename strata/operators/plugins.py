"""Composite segmentations built from the other operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.grid import per_slice
from strata.operators import kernels as K
from strata.registry import operator


#: More seeds than this are not broadcast.
SEEDS = 100_000


@operator("UDF-02")
def bias_corrected(vox: DataFrame, degree: int = 2, mask: Column | None = None) -> DataFrame:
    """Source over a smooth field: a polynomial fitted to the logarithm of every slice, mean kept. Stands in for the
    B-spline fit of the published method."""

    def kernel(a: np.ndarray, m: np.ndarray) -> np.ndarray:
        ok = (m > 0) & (a > 0)
        if ok.sum() < 16:
            return a
        y, x = np.mgrid[-1 : 1 : a.shape[0] * 1j, -1 : 1 : a.shape[1] * 1j]
        terms = np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], axis=-1)
        fit, *_ = np.linalg.lstsq(terms[ok], np.log(a[ok]), rcond=None)
        field = terms @ fit
        return a / np.exp(field - field[ok].mean())

    return per_slice(vox.withColumn("__m", F.lit(1.0) if mask is None else mask.cast("double")), kernel, ["src", "__m"]).drop("__m")


@operator("UDF-03")
def confidence_connected(vox: DataFrame, z: int, y: int, x: int, factor: float = 2.5, rounds: int = 4, radius: int = 1, flow: int = 2) -> DataFrame:
    """Region of a seed within mean and ``factor`` deviations, taken anew from the region each round; 255 inside."""

    def kernel(zs: np.ndarray, a: np.ndarray) -> np.ndarray:
        out = np.zeros(a.shape)
        if zs.flat[0] != z:
            return out
        a = K.diffuse(a, a, 0.05, flow, 1e9, 0.0)
        seed = np.zeros(a.shape, dtype=bool)
        seed[y, x] = True
        part = a[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
        for _ in range(rounds):
            low, high = part.mean() - factor * part.std(), part.mean() + factor * part.std()
            region = K.reach((a >= low) & (a <= high), seed)
            if not region.any():
                break
            part = a[region]
            out = np.where(region, 255.0, 0.0)
        return out

    return per_slice(vox.withColumn("__z", F.col("z").cast("double")), kernel, ["__z", "src"]).drop("__z")


@operator("UDF-04")
def guessed_thresholds(vox: DataFrame, seeds: DataFrame, factor: float = 2.0) -> DataFrame:
    """(low, high): mean and deviation of the source at seed voxels (z, y, x)."""
    keys = seeds.select("z", "y", "x")
    few = keys.limit(SEEDS + 1).count() <= SEEDS
    s = vox.join(F.broadcast(keys) if few else keys, ["z", "y", "x"]).agg(F.avg("src").alias("m"), F.coalesce(F.stddev_pop("src"), F.lit(0.0)).alias("d"))
    return s.select((F.col("m") - factor * F.col("d")).alias("low"), (F.col("m") + factor * F.col("d")).alias("high"))


@operator("UDF-04")
def threshold_level_set(vox: DataFrame, low: float, high: float, rounds: int = 200, rms: float = 0.02, smooth: float = 0.2) -> DataFrame:
    """A front that grows from the target through values from low to high and shrinks elsewhere."""

    def kernel(a: np.ndarray, t: np.ndarray) -> np.ndarray:
        phi = K.signed_distance(t > 0)
        half = max((high - low) / 2, 1e-9)
        speed = np.clip(1 - np.abs(a - (low + high) / 2) / half, -1, 1)
        for i in range(rounds):
            py, px = np.gradient(phi)
            size = np.sqrt(px**2 + py**2) + 1e-9
            step = 0.3 * size * (speed + smooth * (np.gradient(px / size, axis=1) + np.gradient(py / size, axis=0)))
            phi = phi + step
            if np.sqrt((step**2).mean()) < rms:
                break
            if i % 20 == 19:
                phi = K.signed_distance(phi >= 0)
        return np.where(phi >= 0, 255.0, 0.0)

    return per_slice(vox, kernel, ["src", "tgt"])


def hessian(a: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of second derivatives at a scale, the smaller magnitude first."""
    b = K.blur(a, sigma)
    gy, gx = np.gradient(b)
    (yy, yx), xx = np.gradient(gy), np.gradient(gx, axis=1)
    mean, root = (xx + yy) / 2, np.sqrt(((xx - yy) / 2) ** 2 + yx**2)
    one, two = mean - root, mean + root
    swap = np.abs(one) > np.abs(two)
    return np.where(swap, two, one), np.where(swap, one, two)


@operator("UDF-06")
def vesselness(vox: DataFrame, sigma: float, bright: bool = True) -> DataFrame:
    """Likeness to a line: one strong second derivative across, none along."""

    def kernel(a: np.ndarray) -> np.ndarray:
        one, two = hessian(a, sigma)
        s = np.sqrt(one**2 + two**2)
        v = np.exp(-((one / np.where(two == 0, 1, two)) ** 2) / 0.5) * (1 - np.exp(-(s**2) / (2 * max(s.max() / 2, 1e-9) ** 2)))
        return np.where((two < 0) == bright, v, 0.0)

    return per_slice(vox, kernel, ["src"])


@operator("UDF-06")
def blobness(vox: DataFrame, sigma: float, bright: bool = True) -> DataFrame:
    """Likeness to a spot: both second derivatives equally strong."""

    def kernel(a: np.ndarray) -> np.ndarray:
        one, two = hessian(a, sigma)
        return np.where(((two < 0) & (one < 0)) if bright else ((two > 0) & (one > 0)), np.abs(one), 0.0)

    return per_slice(vox, kernel, ["src"])


@operator("UDF-06")
def object_distance(vox: DataFrame, value: float) -> DataFrame:
    return per_slice(vox, lambda a: K.signed_distance(a == value), ["tgt"])


@operator("UDF-07")
def trace_tubes(vox: DataFrame, least: int, cell: float) -> DataFrame:
    """(track, z, id, cx, cy, size, estimates): components of the target followed from slice to slice and filtered."""
    from strata.operators.aggregate import object_features
    from strata.operators.labels import match_objects
    from strata.operators.region import components, propagate
    from strata.streaming.tracking import track

    parts = components(vox, "tgt", full=True, masked=True).withColumn("comp", F.when(F.col("comp") >= 0, F.col("comp")))
    objects = object_features(parts).where(F.col("size") >= least).select("z", F.col("comp").alias("id"), "cx", "cy", "size")
    wide = F.lit(1 << 32)
    links = match_objects(objects, cell).select((F.col("z") * wide + F.col("id")).alias("src"), ((F.col("z") + 1) * wide + F.col("next_id")).alias("dst"))
    tracks = propagate(links)
    named = objects.withColumn("node", F.col("z") * wide + F.col("id")).join(tracks, "node", "left").withColumn("track", F.coalesce("label", "node"))
    return track(named.select("track", F.col("z").cast("long").alias("z"), "id", "cx", "cy", "size"), "track", "z", ["cx", "cy"])
