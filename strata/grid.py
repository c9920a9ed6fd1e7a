"""Voxel grids as tables, and numpy kernels over their slices.

A grid is (z, y, x, src, tgt, tis): float source and target layers and an integer label, one row a voxel. A volume's
slices are its natural partitions: what needs neighbours in a slice runs on one slice at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.registry import operator

VOX = "z int, y int, x int, src double, tgt double, tis int"
#: Rows of the embeddings table that make a slice of the image view.
ROWS = 50
#: Size of its slices; the last one may have fewer rows.
SHAPE = (ROWS, 64)


def embedding_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as slices of ROWS lines: values scaled to whole numbers about 128; labels where bright."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("x", "v"))
    src = F.floor(F.col("v").cast("double") * 255) + 128
    return e.select(
        F.floor(F.col("vec_id") / ROWS).cast("int").alias("z"),
        (F.col("vec_id") % ROWS).cast("int").alias("y"),
        F.col("x").cast("int").alias("x"),
        src.cast("double").alias("src"),
        (F.pmod(src * 3, F.lit(256))).cast("double").alias("tgt"),
        F.when(src > 110, F.col("label") + 1).otherwise(0).cast("int").alias("tis"),
    )


def lineitem_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by line number, supplier and part modulo 64: a sparse volume (z, y, x, src)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    return li.groupBy(F.col("l_linenumber").cast("int").alias("z"), (F.col("l_suppkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")).agg(F.sum("l_quantity").alias("src"))


@operator("PROJ-34")
def dense(vox: DataFrame, z: tuple[int, int], h: int, w: int, **fill: float) -> DataFrame:
    """All voxels of slices z[0] to z[1] - 1; those without a row get the fill values."""
    spark = vox.sparkSession
    cells = spark.range(z[0], z[1]).select(F.col("id").cast("int").alias("z"), F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("i"))
    cells = cells.select("z", F.expr(f"CAST(i DIV {w} AS INT)").alias("y"), F.expr(f"CAST(i % {w} AS INT)").alias("x"))
    out = cells.join(vox, ["z", "y", "x"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def to_slices(vox: DataFrame) -> DataFrame:
    """(z, h, w, src, tgt, tis): one row a slice with row-major arrays."""
    rows = F.sort_array(F.collect_list(F.struct("y", "x", "src", "tgt", "tis")))

    def layer(name: str) -> Column:
        return F.transform("r", lambda s: s.getField(name)).alias(name)

    return vox.groupBy("z").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), rows.alias("r")).select("z", "h", "w", *map(layer, ("src", "tgt", "tis")))


def to_voxels(slices: DataFrame) -> DataFrame:
    cells = slices.select("z", "w", F.posexplode(F.arrays_zip("src", "tgt", "tis")).alias("i", "c"))
    return cells.select("z", F.expr("CAST(i DIV w AS INT)").alias("y"), F.expr("CAST(i % w AS INT)").alias("x"), "c.src", "c.tgt", "c.tis")


def image(pdf: pd.DataFrame, col: str, fill: float = 0, shape: tuple[int, int] = (0, 0)) -> np.ndarray:
    """A slice's column as an (h, w) array, from its first row and column to its last, or at least of a shape."""
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    out = np.full((max(int(y.max()) + 1, shape[0]), max(int(x.max()) + 1, shape[1])), fill, dtype=np.int64 if col == "tis" else np.float64)
    out[y, x] = pdf[col].to_numpy()
    return out


def per_slice(vox: DataFrame, kernel: Callable[..., np.ndarray], inputs: list[str], output: str = "tgt", shape: tuple[int, int] | None = None) -> DataFrame:
    """``vox`` with column ``output`` from a kernel of (h, w) arrays of the inputs. One task holds one slice. If slices
    have a ``shape``, those with fewer voxels get it too, and NaN where no voxel is; a kernel's NaN becomes null."""
    columns = vox.columns if output in vox.columns else [*vox.columns, output]
    kind = dict(vox.dtypes).get(output, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(*([image(pdf, c) for c in inputs] if shape is None else [image(pdf, c, np.nan, shape) for c in inputs]))
        pdf = pdf.assign(**{output: out[pdf["y"].to_numpy(), pdf["x"].to_numpy()]})
        return pdf[columns]

    schema = ", ".join(f"{c} {dict(vox.dtypes).get(c, kind)}" for c in columns)
    return vox.groupBy("z").applyInPandas(run, schema)


def per_volume(vox: DataFrame, kernel: Callable[..., np.ndarray], inputs: list[str], output: str = "tgt", key: str | None = None) -> DataFrame:
    """As per_slice, over (n, h, w) arrays. A task holds a whole volume; ``key`` names the column that tells volumes
    apart (without it there is one). Only for kernels whose result at a voxel can depend on any other."""
    columns = vox.columns if output in vox.columns else [*vox.columns, output]
    kind = dict(vox.dtypes).get(output, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pdf[c].to_numpy() - pdf[c].min() * (c == "z") for c in ("z", "y", "x"))
        shape = tuple(int(a.max()) + 1 for a in at)
        arrays = []
        for c in inputs:
            a = np.zeros(shape, dtype=np.int64 if c == "tis" else np.float64)
            a[at] = pdf[c].to_numpy()
            arrays.append(a)
        return pdf.assign(**{output: kernel(*arrays)[at]})[columns]

    schema = ", ".join(f"{c} {dict(vox.dtypes).get(c, kind)}" for c in columns)
    return vox.groupBy(*([key] if key else [])).applyInPandas(run, schema)


def at_point(vox: DataFrame, col: str, z: int, y: int, x: int) -> float:
    """One voxel's value (0 outside the grid)."""
    row = vox.where((F.col("z") == z) & (F.col("y") == y) & (F.col("x") == x)).select(col).first()
    return row[0] if row else 0


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
