"""Queries that write tables out and read the files back: sources and sinks in one, with the SQL of the table itself."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import labels
from strata.sources import files

Query = Callable[[SparkSession, str], DataFrame]


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where all runs on one machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strata-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def by_files(vox: DataFrame, kind: str, col: str, read: Callable[[SparkSession, str], DataFrame], **how) -> DataFrame:
    to = folder(vox.sparkSession)
    if not files.save_files(files.encoded(vox, kind, col, **how), to) and not vox.isEmpty():
        raise RuntimeError(f"no {kind} file of a table that has rows")
    return read(vox.sparkSession, f"{to}/*.{ {'vtkb': 'vtk'}.get(kind, kind)}")


def build(layers: Query, tissues: Query) -> dict[str, tuple[Query, str]]:
    """name: (query, SQL over ``lay`` or ``tissues``). Slices are numbered from 0 where files don't say otherwise."""
    out: dict[str, tuple[Query, str]] = {}
    zero = lambda s, d: layers(s, d).withColumn("z", F.col("z") - 1)
    colours = lambda s, d: tissues(s, d).select("id", "name", *[(F.col("id") % k / 8).alias(c) for c, k in (("r", 3), ("g", 5), ("b", 7))], F.lit(0.5).alias("opac"))
    shade = "CAST(id % 3 AS DOUBLE) / 8 AS r, CAST(id % 5 AS DOUBLE) / 8 AS g, CAST(id % 7 AS DOUBLE) / 8 AS b"
    for code, kind in (("scan01", "bmp"), ("scan02", "png")):
        out[f"{code}_{kind}_slices"] = (lambda s, d, kind=kind: by_files(layers(s, d), kind, "tgt", files.read_images).select("z", "y", "x", "src"), "SELECT CAST(z - 1 AS INT) AS z, y, x, tgt AS src FROM lay")
    raw = lambda s, p, dtype: files.read_raw(s, p, 64, 64, dtype).select(F.regexp_extract("file", r"slice(\d+)", 1).cast("int").alias("z"), "y", "x", "src")
    out["scan05_raw_bytes"] = (lambda s, d: by_files(layers(s, d), "raw", "tis", lambda s, p: raw(s, p, "u1"), dtype="u1"), "SELECT z, y, x, CAST(tis AS DOUBLE) AS src FROM lay")
    out["scan06_raw_floats"] = (lambda s, d: by_files(layers(s, d), "raw", "src", lambda s, p: raw(s, p, "f4")), "SELECT z, y, x, src FROM lay")
    for kind in ("mha", "nrrd", "gz", "vti"):
        out[f"scan12_volume_{kind}"] = (lambda s, d, kind=kind: by_files(zero(s, d), kind, "src", files.read_volumes).select("z", "y", "x", "src"), "SELECT CAST(z - 1 AS INT) AS z, y, x, src FROM lay")
    for kind in ("vtk", "vtkb", "am"):
        out[f"sink09_volume_{kind}"] = (lambda s, d, kind=kind: by_files(zero(s, d), kind, "src", files.read_volumes).select("z", "y", "x", "src"), "SELECT CAST(z - 1 AS INT) AS z, y, x, src FROM lay")
    out["scan13_volume_info"] = (
        lambda s, d: by_files(zero(s, d), "mha", "src", files.volume_info, spacing=(0.5, 1.0, 2.0)).select("w", "h", "n", "dx", "dy", "dz"),
        "SELECT CAST(max(x) + 1 AS INT) AS w, CAST(max(y) + 1 AS INT) AS h, CAST(max(z) AS INT) AS n, 0.5::DOUBLE AS dx, 1.0::DOUBLE AS dy, 2.0::DOUBLE AS dz FROM lay",
    )

    def store(s: SparkSession, d: str) -> DataFrame:
        to = folder(s)
        files.write_store(layers(s, d), to)
        return files.read_store(s, to, (2, 6), ["z", "y", "x", "src", "tgt", "tis"])

    out["scan14_store_slices"] = (store, "SELECT z, y, x, src, tgt, tis FROM lay WHERE z >= 2 AND z < 6")
    out["sink14_merged_projects"] = (
        lambda s, d: files.merge_projects([zero(s, d).select("z", "y", "x", "src"), zero(s, d).select("z", "y", "x", "src")]),
        "SELECT CAST(z - 1 AS INT) AS z, y, x, src FROM lay UNION ALL SELECT CAST(z + 6 AS INT), y, x, src FROM lay",
    )
    out["sink05_resized"] = (
        lambda s, d: files.resized(zero(s, d), (64, 64, 7), (-3, -2, -1), (-1, -4, 0)),
        "SELECT CAST(z - 2 AS INT) AS z, CAST(y - 2 AS INT) AS y, CAST(x - 3 AS INT) AS x, src FROM lay WHERE z > 1 AND y >= 2 AND y < 60 AND x >= 3 AND x < 63",
    )
    out["sink06_axes_swapped"] = (lambda s, d: files.axis_swapped(layers(s, d), "x", "z"), "SELECT x AS z, y, z AS x, src FROM lay")

    def lists(s: SparkSession, d: str) -> DataFrame:
        to = folder(s)
        files.write_lines(files.tissue_lines(colours(s, d)), to)
        return files.read_tissues(s, to)

    # Names with blanks stay one name; a list numbers its tissues in order.
    out["scan22_tissue_list"] = (lists, f"SELECT id, name, {shade}, 0.5::DOUBLE AS opac, false AS locked FROM tissues")
    out["sink15_tissue_lines"] = (
        lambda s, d: files.tissue_lines(colours(s, d)),
        f"""SELECT 0::BIGINT AS line, 'V7' AS value UNION ALL SELECT 1, 'N' || count(*) FROM tissues UNION ALL
        SELECT CAST(id + 1 AS BIGINT), printf('C %.6f %.6f %.6f %.6f %s', r, g, b, 0.5::DOUBLE, name) FROM (SELECT id, name, {shade} FROM tissues)""",
    )
    out["sink11_tissue_index"] = (lambda s, d: files.tissue_index(tissues(s, d)), """SELECT 0 AS id, '0 "Background"' AS value UNION ALL SELECT id, id || ' "' || name || '"' FROM tissues""")
    out["sort03_smallest_of_all"] = (lambda s, d: labels.smallest(layers(s, d).withColumn("k", (F.col("z") * 64 + F.col("y")) * 64 + F.col("x")), "src", "k", 50).select("k", "src"), "SELECT (z * 64 + y) * 64 + x AS k, src FROM lay ORDER BY src, k LIMIT 50")
    return out
