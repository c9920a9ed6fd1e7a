"""Filters and predicates on voxels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.grid import at_point, per_slice
from strata.registry import operator


def leading_cuts(value: Column, cuts: list[float]) -> Column:
    """How many cuts in front are below the value; the first that isn't ends the count, so unsorted cuts differ from a
    count of all."""
    out = F.lit(len(cuts))
    for j in range(len(cuts) - 1, -1, -1):
        out = F.when(value <= float(cuts[j]), F.lit(j)).otherwise(out)
    return out


@operator("FILT-01")
def threshold(vox: DataFrame, cuts: list[float], source: str = "src") -> DataFrame:
    """Class j of n cuts becomes j * 255 / n; without cuts the target is left as it is."""
    if not cuts:
        return vox
    return vox.withColumn("tgt", (leading_cuts(F.col(source), cuts) * 255.0 / len(cuts)).cast("double"))


@operator("FILT-02")
def tile_threshold(vox: DataFrame, h: int, w: int, n1: int, n2: int, least: int, ratio: float) -> DataFrame:
    """Each slice in n1 x n2 tiles, each cut at its own histogram's valleys."""
    from strata.operators.kernels import valleys

    def kernel(src: np.ndarray) -> np.ndarray:
        out = np.zeros_like(src)
        for rows in np.array_split(np.arange(src.shape[0]), n2):
            for cols in np.array_split(np.arange(src.shape[1]), n1):
                tile = src[np.ix_(rows, cols)]
                cuts = valleys(np.bincount(np.clip(tile, 0, 255).astype(int).ravel(), minlength=256), least, ratio)
                out[np.ix_(rows, cols)] = np.searchsorted(cuts, tile, side="left") * 255.0 / max(len(cuts), 1)
        return out

    return per_slice(vox, kernel, ["src"])


def writable(override: bool, locked: list[int] | None = None) -> Column:
    """Which labels may be overwritten: the background, or with override any that isn't locked."""
    if not override:
        return F.col("tis") == 0
    return ~F.col("tis").isin(locked) if locked else F.lit(True)


@operator("FILT-03")
def add_label(vox: DataFrame, label: int, value: float, override: bool = False, locked: list[int] | None = None) -> DataFrame:
    return vox.withColumn("tis", F.when((F.col("tgt") == value) & writable(override, locked), F.lit(label)).otherwise(F.col("tis")))


@operator("FILT-03")
def add_label_at(vox: DataFrame, label: int, z: int, y: int, x: int, override: bool = False, locked: list[int] | None = None) -> DataFrame:
    return add_label(vox, label, at_point(vox, "tgt", z, y, x), override, locked)


@operator("FILT-04")
def add_label_above(vox: DataFrame, label: int, value: float) -> DataFrame:
    return vox.withColumn("tis", F.when(F.col("tgt") >= value, F.lit(label)).otherwise(F.col("tis")))


@operator("FILT-05")
def subtract_label(vox: DataFrame, label: int, value: float) -> DataFrame:
    return vox.withColumn("tis", F.when((F.col("tgt") == value) & (F.col("tis") == label), F.lit(0)).otherwise(F.col("tis")))


@operator("FILT-06")
def clear_label(vox: DataFrame, label: int) -> DataFrame:
    return vox.withColumn("tis", F.when(F.col("tis") == label, F.lit(0)).otherwise(F.col("tis")))


@operator("FILT-07")
def mask_source(vox: DataFrame, selected: list[int], value: float) -> DataFrame:
    return vox.withColumn("src", F.when(~F.col("tis").isin(selected), F.lit(float(value))).otherwise(F.col("src")))


@operator("FILT-08")
def cap_label(vox: DataFrame, largest: int) -> DataFrame:
    return vox.withColumn("tis", F.when(F.col("tis") > largest, F.lit(0)).otherwise(F.col("tis")))


@operator("FILT-09")
def has_label(vox: DataFrame, label: int) -> DataFrame:
    """(z, found) of every slice."""
    return vox.groupBy("z").agg(F.max((F.col("tis") == label).cast("int")).cast("boolean").alias("found"))


@operator("FILT-10")
def next_slice_with(vox: DataFrame, label: int, active: int) -> DataFrame:
    """The next slice after the active one that has the label, from the first again after the last; none: no row."""
    return vox.where(F.col("tis") == label).select("z").distinct().orderBy((F.col("z") <= active).cast("int"), "z").limit(1)


@operator("FILT-11")
def flood_exterior(vox: DataFrame, value: float, col: str = "tgt") -> DataFrame:
    """Zeros connected (4 neighbours) to the border of their slice get the value."""
    from strata.operators.kernels import exterior

    return per_slice(vox, lambda a: np.where(exterior(a == 0), value, a), [col], col)


@operator("FILT-12")
def bounding_box(vox: DataFrame, condition: Column) -> DataFrame:
    return vox.where(condition).agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for f, n in ((F.min, "min"), (F.max, "max"))])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
