"""Sources and sinks: files become voxel tables on the executors, through Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.registry import operator
from strata.sources import formats

CELLS = "file string, z int, y int, x int, src double"


def binary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def cells(name: str, a: np.ndarray, z0: int = 0) -> pd.DataFrame:
    a = a[None] if a.ndim == 2 else a
    z, y, x = np.indices(a.shape, dtype=np.int32)
    return pd.DataFrame({"file": name, "z": z.ravel() + np.int32(z0), "y": y.ravel(), "x": x.ravel(), "src": a.ravel().astype(float)})


def crop(vox: DataFrame, x: int = 0, y: int = 0, w: int | None = None, h: int | None = None) -> DataFrame:
    """A rectangle of every slice, moved to its corner."""
    inside = (F.col("x") >= x) & (F.col("y") >= y)
    inside = inside & (F.col("x") < x + w) if w else inside
    inside = inside & (F.col("y") < y + h) if h else inside
    return vox.where(inside).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


@operator("SCAN-01", "SCAN-02", "SCAN-04")
def read_images(spark: SparkSession, path: str | list[str], weights: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> DataFrame:
    """(file, z, y, x, src): bitmaps, PNG or JPEG, one slice a file in order of the names; colours become grey."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, z, data in zip(pdf["path"], pdf["z"], pdf["content"], strict=True):
                pixels = formats.read_bmp(data) if data[:2] == b"BM" else formats.read_png(data)
                yield cells(name, formats.grey(pixels, weights), int(z))

    files = binary(spark, path).select("path", "content")
    numbers = numbered(files)
    jpeg = F.col("path").rlike("(?i)\\.jpe?g$")
    own = files.where(~jpeg).join(numbers, "path").mapInPandas(decode, CELLS)
    if files.where(jpeg).select("path").isEmpty():
        return own
    img = spark.read.format("image").load(path).select("image.*").where(F.col("origin").rlike("(?i)\\.jpe?g$"))
    size, stride = F.col("height") * F.col("width"), F.col("nChannels")
    byte = lambda i: F.expr(f"conv(hex(substring(data, i * nChannels + {i} + 1, 1)), 16, 10)").cast("double")
    rows = img.withColumn("i", F.explode(F.sequence(F.lit(0), size - 1)))
    grey = F.when(stride >= 3, byte(2) * weights[0] + byte(1) * weights[1] + byte(0) * weights[2]).otherwise(byte(0))
    told = rows.join(numbers, F.regexp_extract("origin", "[^/]*$", 0) == F.regexp_extract("path", "[^/]*$", 0))
    return own.unionByName(told.select(F.col("origin").alias("file"), "z", F.expr("CAST(i DIV width AS INT)").alias("y"), F.expr("CAST(i % width AS INT)").alias("x"), grey.alias("src")))


def numbered(files: DataFrame) -> DataFrame:
    """(path, z): place of each file in order of the names. One row a file."""
    return files.select("path").withColumn("z", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))


@operator("SCAN-05", "SCAN-06", "SCAN-07")
def read_raw(spark: SparkSession, path: str | list[str], w: int, h: int, kind: str = "u1", first: int = 0, slices: int | None = None) -> DataFrame:
    """(file, z, y, x, src) of headerless volumes: little-endian u1, u2 or f4, from slice ``first`` on."""
    size = w * h * np.dtype(kind).itemsize

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                n = len(data) // size - first if slices is None else min(slices, len(data) // size - first)
                for k in range(max(n, 0)):
                    yield cells(name, np.frombuffer(data, "<" + kind, w * h, (first + k) * size).reshape(h, w), k)

    return binary(spark, path).select("path", "content").mapInPandas(decode, CELLS)


@operator("SCAN-11", "SCAN-12", "SCAN-13")
def read_volumes(spark: SparkSession, path: str | list[str], z: tuple[int, int] | None = None, layer: str | None = None) -> DataFrame:
    """(file, z, y, x, src) of MetaImage, NRRD, NIfTI, VTI, legacy VTK, AmiraMesh or AVW files; only slices in ``z`` leave the reader."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                v = formats.read_volume(name, data)
                a = v.layers[layer] if layer else v.first
                for k in range(*(z or (0, len(a)))):
                    if k < len(a):
                        yield cells(name, a[k], k)

    return binary(spark, path).select("path", "content").mapInPandas(decode, CELLS)


@operator("SCAN-12", "SCAN-21")
def volume_info(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, w, h, n, dx, dy, dz, tr) from the headers."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                v = formats.read_volume(name, data)
                n, h, w = v.first.shape
                rows.append((name, w, h, n, *v.spacing, [float(t) for t in v.transform]))
            yield pd.DataFrame(rows, columns=["file", "w", "h", "n", "dx", "dy", "dz", "tr"])

    return binary(spark, path).select("path", "content").mapInPandas(decode, "file string, w int, h int, n int, dx double, dy double, dz double, tr array<double>")


@operator("SCAN-08", "SCAN-09", "SCAN-10", "SCAN-16")
def read_dicom(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Voxels (file, z, y, x, src) and (file, pz, dx, dy, thickness, series, z): slices by falling position."""

    def tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, *(formats.read_dicom(d)[1][k] for k in ("pz", "dx", "dy", "thickness", "series"))) for n, d in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["file", "pz", "dx", "dy", "thickness", "series"])

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, z, data in zip(pdf["path"], pdf["z"], pdf["content"], strict=True):
                yield cells(name, formats.read_dicom(data)[0], int(z))

    files = binary(spark, path).select("path", "content")
    meta = files.mapInPandas(tags, "file string, pz double, dx double, dy double, thickness double, series double")
    meta = sort_slices(meta)
    return files.join(meta.select(F.col("file").alias("path"), "z"), "path").mapInPandas(pixels, CELLS), meta


@operator("SCAN-09")
def sort_slices(meta: DataFrame) -> DataFrame:
    """``z`` by falling slice position, files with equal position in order of their names."""
    return meta.withColumn("z", (F.row_number().over(Window.partitionBy("series").orderBy(F.desc("pz"), "file")) - 1).cast("int"))


@operator("SCAN-09")
def mean_spacing(meta: DataFrame) -> DataFrame:
    """(first - last) / (n - 1) of the positions; -1 for fewer than two."""
    n = F.count("*")
    return meta.agg(F.when(n < 2, -1.0).otherwise((F.max("pz") - F.min("pz")) / F.greatest(n - 1, F.lit(1))).alias("spacing"))


@operator("SCAN-10")
def series(meta: DataFrame) -> DataFrame:
    return meta.select("series").distinct().orderBy("series")


@operator("SCAN-14", "SCAN-15", "SINK-01", "SINK-02", "SINK-13")
def write_store(vox: DataFrame, path: str, mode: str = "overwrite", compression: str = "zstd") -> None:
    """The native store: Parquet by slice, so a range of slices reads only its folders."""
    vox.write.mode(mode).option("compression", compression).partitionBy("z").parquet(path)


@operator("SCAN-14", "SCAN-15")
def read_store(spark: SparkSession, path: str, z: tuple[int, int] | None = None, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows if z is None else rows.where((F.col("z") >= z[0]) & (F.col("z") < z[1]))
    return rows.select(*(columns or rows.columns))


@operator("SINK-01", "SINK-14")
def merge_projects(projects: list[DataFrame]) -> DataFrame:
    """Slices of all projects, one after another. Their slices must have one size."""
    sizes = {tuple(p.agg(F.max("y"), F.max("x")).first()) for p in projects}
    if len(sizes) > 1:
        raise ValueError(f"slices differ in size: {sorted(sizes)}")
    out, at = None, 0
    for p in projects:
        n = p.agg(F.max("z") + 1).first()[0] or 0
        moved = p.withColumn("z", F.col("z") + at)
        out, at = moved if out is None else out.unionByName(moved), at + n
    return out


@operator("SCAN-18")
def voxelise(triangles: DataFrame, h: int, w: int) -> DataFrame:
    """(z, y, x): voxels inside closed surfaces of triangles (id, ax..cz): crossings of a line along x, by parity.
    Each triangle meets only the slices and lines of its box."""
    low = {c: F.least(*[F.col(p + c) for p in "abc"]) for c in "xyz"}
    high = {c: F.greatest(*[F.col(p + c) for p in "abc"]) for c in "xyz"}
    t = triangles.withColumn("z", F.explode(F.sequence(F.ceil(low["z"]).cast("int"), F.ceil(high["z"]).cast("int"))))
    t = t.withColumn("y", F.explode(F.sequence(F.greatest(F.ceil(low["y"]).cast("int"), F.lit(0)), F.least(F.ceil(high["y"]).cast("int"), F.lit(h - 1)))))
    y, z = F.col("y") + 1e-7, F.col("z") + 1e-7
    d = (F.col("by") - F.col("ay")) * (F.col("cz") - F.col("az")) - (F.col("cy") - F.col("ay")) * (F.col("bz") - F.col("az"))
    u = F.try_divide((y - F.col("ay")) * (F.col("cz") - F.col("az")) - (F.col("cy") - F.col("ay")) * (z - F.col("az")), d)
    v = F.try_divide((F.col("by") - F.col("ay")) * (z - F.col("az")) - (y - F.col("ay")) * (F.col("bz") - F.col("az")), d)
    hits = t.withColumns({"u": u, "v": v}).where("u >= 0 and v >= 0 and u + v <= 1").select("z", "y", (F.col("ax") + F.col("u") * (F.col("bx") - F.col("ax")) + F.col("v") * (F.col("cx") - F.col("ax"))).alias("at"))
    line = Window.partitionBy("z", "y").orderBy("at")
    spans = hits.withColumns({"k": F.row_number().over(line), "end": F.lead("at").over(line)}).where("k % 2 = 1 and end is not null")
    first, last = F.greatest(F.ceil("at").cast("int"), F.lit(0)), F.least(F.floor("end").cast("int"), F.lit(w - 1))
    return spans.where(first <= last).select("z", "y", F.explode(F.sequence(first, last)).alias("x")).distinct()


@operator("SCAN-20")
def read_markers(spark: SparkSession, path: str, transform: list[float], spacing: tuple[float, float, float], size: tuple[int, int, int]) -> DataFrame:
    """(name, x, y, z) of a .pts text: names and world points, taken back to voxels and clamped to the volume."""
    inv = np.linalg.inv(np.array(transform, dtype=float).reshape(4, 4))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(Version\b.*|\d+)?\s*$"))
    parts = F.split(F.trim("value"), r"\s+")
    n = F.size(parts)
    p = [F.element_at(parts, n - 2 + i).try_cast("double") for i in range(3)]
    rows = lines.select(F.array_join(F.slice(parts, 1, F.greatest(n - 3, F.lit(0))), " ").alias("name"), *[c.alias(f"w{i}") for i, c in enumerate(p)]).where("w0 is not null and w1 is not null and w2 is not null")

    def back(i: int) -> Column:
        v = sum((F.col(f"w{j}") * float(inv[i, j]) for j in range(3)), F.lit(float(inv[i, 3]))) / spacing[i]
        return F.least(F.greatest(F.floor(v + 0.5).cast("int"), F.lit(0)), F.lit(size[i] - 1))

    return rows.select("name", back(0).alias("x"), back(1).alias("y"), back(2).alias("z"))


@operator("SINK-12")
def marker_table(marks: DataFrame, transform: list[float], spacing: tuple[float, float, float]) -> DataFrame:
    """(X, Y, Z, Label): world points; marks without a name are numbered."""
    t = [float(v) for v in transform]
    p = [F.col(c) * float(s) for c, s in zip("xyz", spacing, strict=True)]
    name = F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.concat(F.lit("Point "), F.row_number().over(Window.orderBy("z", "y", "x")).cast("string"))).otherwise(F.col("name"))
    return marks.select(*[(p[0] * t[4 * i] + p[1] * t[4 * i + 1] + p[2] * t[4 * i + 2] + t[4 * i + 3]).alias(n) for i, n in enumerate("XYZ")], name.alias("Label"))


@operator("SINK-12")
def write_markers(marks: DataFrame, path: str) -> None:
    """A comma-separated table with a header."""
    marks.write.mode("overwrite").csv(path, header=True)


TISSUE_LINE = r"^C\s*(\S+)\s+(\S+)\s+(\S+)(?:\s+(\S+))?\s+(\S.*?)\s*$"
#: Columns of a colour table: number, name, red, green, blue, transparency from 0 to 255.
TABLE_LINE = r"^\s*(\d+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*$"


@operator("SCAN-22")
def read_tissues(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, r, g, b, opac, locked) of a tissue list (V, N and C lines) or a numbered colour table."""
    text = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    own = text.where(F.col("value").rlike(TISSUE_LINE)).withColumn("id", F.row_number().over(Window.orderBy("n")).cast("int"))

    def group(pattern: str, k: int) -> Column:
        return F.regexp_extract("value", pattern, k)

    mine = own.select("id", group(TISSUE_LINE, 5).alias("name"), *[group(TISSUE_LINE, k).cast("double").alias(c) for k, c in ((1, "r"), (2, "g"), (3, "b"))], F.coalesce(group(TISSUE_LINE, 4).try_cast("double"), F.lit(0.5)).alias("opac"))
    table = text.where(F.col("value").rlike(TABLE_LINE)).select(group(TABLE_LINE, 1).cast("int").alias("id"), group(TABLE_LINE, 2).alias("name"), *[(group(TABLE_LINE, k).cast("double") / 255).alias(c) for k, c in ((3, "r"), (4, "g"), (5, "b"))], F.lit(0.5).alias("opac"))
    return mine.unionByName(table.where("id > 0")).withColumn("locked", F.lit(False))


@operator("SINK-15")
def tissue_lines(tissues: DataFrame, version: int = 7) -> DataFrame:
    """Lines of a tissue list in order (line, value)."""
    t = tissues.where("id > 0")
    body = t.select((F.col("id") + 1).cast("long").alias("line"), F.concat_ws(" ", F.lit("C"), *[F.format_string("%.6f", c) for c in ("r", "g", "b", "opac")], F.col("name")).alias("value"))
    count = t.agg(F.lit(1).cast("long").alias("line"), F.concat(F.lit("N"), F.count("*").cast("string")).alias("value"))
    head = t.sparkSession.range(1).select(F.lit(0).cast("long").alias("line"), F.lit(f"V{version}").alias("value"))
    return head.unionByName(count).unionByName(body)


@operator("SINK-11")
def tissue_index(tissues: DataFrame) -> DataFrame:
    rows = tissues.where("id > 0").select("id", F.concat(F.col("id").cast("string"), F.lit(' "'), F.col("name"), F.lit('"')).alias("value"))
    return tissues.sparkSession.sql("""SELECT 0 AS id, '0 "Background"' AS value""").unionByName(rows)


@operator("SINK-09", "SINK-11", "SINK-15", "SINK-16")
def write_lines(rows: DataFrame, path: str, order: str = "line") -> None:
    """One text file in order: headers, lists and contours are short."""
    rows.orderBy(order).select("value").coalesce(1).write.mode("overwrite").text(path)


@operator("SCAN-23")
def read_hierarchy(spark: SparkSession, path: str, folder: str = "folder", leaf: str = "tissue", name: str = "name") -> DataFrame:
    """(file, id, parent, name, is_folder) of a tree of folders and tissues."""
    import xml.etree.ElementTree as ET

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, data in zip(pdf["path"], pdf["content"], strict=True):
                stack = [(ET.fromstring(data), None)]
                count = 0
                while stack:
                    node, parent = stack.pop()
                    here = parent
                    if node.tag in (folder, leaf):
                        here = count
                        count += 1
                        rows.append((file, here, parent, node.get(name), node.tag == folder))
                    stack += [(c, here) for c in reversed(node)]
            yield pd.DataFrame(rows, columns=["file", "id", "parent", "name", "is_folder"]).astype({"parent": "Int32"})

    return binary(spark, path).select("path", "content").mapInPandas(parse, "file string, id int, parent int, name string, is_folder boolean")


@operator("SCAN-24")
def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """(z, tissue, outer, line_no, points): after S (slice), T (tissue) and O or I lines, ``count: x,y x,y``."""
    text = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for body in pdf["value"]:
                z = tissue = k = 0
                outer = True
                for line in body.splitlines():
                    if line[:1] in "ST" and line[1:].strip().isdigit():
                        z, tissue, k = (int(line[1:]), tissue, 0) if line[0] == "S" else (z, int(line[1:]), 0)
                    elif line[:1] in "OI" and line[1:].strip().isdigit():
                        outer, k = line[0] == "O", 0
                    elif ":" in line:
                        points = [tuple(map(int, p.split(","))) for p in line.split(":", 1)[1].split()]
                        rows.append((z, tissue, outer, k, [{"x": x, "y": y} for x, y in points]))
                        k += 1
            yield pd.DataFrame(rows, columns=["z", "tissue", "outer", "line_no", "points"])

    return text.mapInPandas(parse, "z int, tissue int, outer boolean, line_no int, points array<struct<x:int,y:int>>")


@operator("SINK-16")
def contour_lines(contours: DataFrame) -> DataFrame:
    """(z, tissue, outer, line_no, value) with the text of every line."""
    points = F.array_join(F.transform("points", lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")
    return contours.select("z", "tissue", "outer", "line_no", F.concat(F.size("points").cast("string"), F.lit(": "), points).alias("value"))


@operator("SCAN-25")
def read_centers(spark: SparkSession, path: str) -> DataFrame:
    """(class, dim, value) of lines ``class<TAB>value``."""
    rows = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    t = rows.select("n", parts[0].cast("int").alias("class"), parts[1].cast("double").alias("v"))
    return t.select("class", (F.row_number().over(Window.partitionBy("class").orderBy("n")) - 1).cast("int").alias("dim"), F.col("v").alias("value"))


@operator("SCAN-26")
def pending(images: DataFrame, labels: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(name, image, label) of files with equal names, without those that are done."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    a = images.select(name.alias("name"), F.col("path").alias("image"))
    b = labels.select(name.alias("name"), F.col("path").alias("label"))
    out = a.join(b, "name")
    return out if done is None else out.join(done.select(name.alias("name")), "name", "left_anti")


@operator("SCAN-27")
def register_dataset(vox: DataFrame, name: str, like: DataFrame) -> None:
    """A named view, if its size is that of ``like``."""
    from strata.operators.point import dims

    size = [tuple(dims(d).select("w", "h", "n").first()) for d in (vox, like)]
    if size[0] != size[1]:
        raise ValueError(f"{name} has size {size[0]}, expected {size[1]}")
    vox.createOrReplaceTempView(name)


@operator("SINK-03", "SINK-04", "SINK-05", "SINK-07", "SINK-08", "SINK-09", "SINK-17")
def encoded(vox: DataFrame, kind: str, col: str = "src", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), transform: list[float] | None = None, dtype: str = "f4") -> DataFrame:
    """(name, content): a file a slice (raw, bmp, png), made on the executors, or one of the whole volume (mha, nrrd,
    gz for zipped NIfTI, vti, vtk and am as text, vtkb for binary vtk)."""
    from strata.grid import image

    def one_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        a = image(pdf, col)
        data = {"raw": lambda: a.astype("<" + dtype).tobytes(), "bmp": lambda: formats.write_bmp(a), "png": lambda: formats.write_png(a)}[kind]()
        return pd.DataFrame({"name": [f"slice{int(pdf['z'].iloc[0]):05d}.{kind}"], "content": [data]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(int(pdf[c].max()) + 1 for c in ("z", "y", "x"))
        a = np.zeros(shape, dtype=dtype)
        a[pdf["z"], pdf["y"], pdf["x"]] = pdf[col]
        v = formats.Volume({col: a}, spacing, transform or list(formats.IDENTITY))
        return pd.DataFrame({"name": [f"volume.{ {'gz': 'nii.gz', 'vtkb': 'vtk'}.get(kind, kind)}"], "content": [formats.WRITERS[kind](v)]})

    rows = vox.select("z", "y", "x", col)
    if kind in ("raw", "bmp", "png"):
        return rows.groupBy("z").applyInPandas(one_slice, "name string, content binary")
    return rows.groupBy().applyInPandas(whole, "name string, content binary")


@operator("SINK-03", "SINK-04", "SINK-07")
def save_files(files: DataFrame, folder: str) -> int:
    """Write (name, content) as files of any file system Spark knows; gives their number. They are made once, kept in the
    shared folder, and come to the driver a partition at a time; it is an error if any of them doesn't."""
    from strata.operators.region import checkpoint_dir

    spark, n = files.sparkSession, 0
    checkpoint_dir(spark)
    kept = files.select("name", "content").checkpoint()
    rows = kept.rdd
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for part in range(rows.getNumPartitions()):
        for r in spark.sparkContext.runJob(rows, list, [part]):
            path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}")
            out = path.getFileSystem(conf).create(path, True)
            out.write(bytearray(r["content"]))
            out.close()
            n += 1
    if n != kept.count():
        raise RuntimeError(f"{n} of {kept.count()} files were written to {folder}")
    return n


@operator("SINK-05")
def resized(vox: DataFrame, size: tuple[int, int, int], low: tuple[int, int, int], high: tuple[int, int, int], col: str = "src") -> DataFrame:
    """Margins (x, y, z) added with zeros, or with negative numbers taken off; the first voxel is (0, 0, 0) again."""
    w, h, n = (s + a + b for s, a, b in zip(size, low, high, strict=True))
    moved = vox.select((F.col("z") + low[2]).alias("z"), (F.col("y") + low[1]).alias("y"), (F.col("x") + low[0]).alias("x"), F.col(col))
    from strata.grid import dense

    return dense(moved, (0, n), h, w, **{col: 0})


@operator("SINK-06")
def axis_swapped(vox: DataFrame, a: str, b: str, col: str = "src") -> DataFrame:
    names = {a: b, b: a}
    return vox.select(*[F.col(c).alias(names.get(c, c)) for c in ("z", "y", "x")], col)


@operator("SINK-08")
def matlab(values: np.ndarray, name: str) -> bytes:
    """A level 5 MAT file with one matrix of doubles."""
    import struct

    def element(kind: int, body: bytes) -> bytes:
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    shape = values.shape if values.ndim > 1 else (1, values.size)
    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode()) + element(9, np.asarray(values, "<f8").reshape(shape).tobytes(order="F"))
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<HH", 0x0100, 0x4D49) + element(14, body)


@operator("SINK-10")
def region_extents(vox: DataFrame, tissues: DataFrame, spacing: tuple[float, float, float], offset: tuple[float, float, float], project: str = "") -> DataFrame:
    """(id, name, extent, global_bounds, value): extents of the labels that occur, with their XML."""
    from strata.operators.aggregate import extents

    e = extents(vox).join(tissues.select("id", "name", "r", "g", "b"), F.col("tis") == F.col("id"))
    ends = [(f"{m}_{c}", s, o) for c, s, o in zip("xyz", spacing, offset, strict=True) for m in ("min", "max")]
    extent = F.concat_ws(" ", *[F.col(c).cast("string") for c, _, _ in ends])
    bounds = F.concat_ws(" ", *[(F.col(c) * float(s) + float(o)).cast("string") for c, s, o in ends])
    rows = e.withColumns({"extent": extent, "global_bounds": bounds})
    xml = F.format_string('\t<label id="%d" name="%s" color="%s %s %s">\n\t\t<dataset filename="' + project + '" extent="%s" global_bounds="%s">\n\t\t</dataset>\n\t</label>', "id", "name", F.col("r").cast("string"), F.col("g").cast("string"), F.col("b").cast("string"), "extent", "global_bounds")
    return rows.select("id", "name", "extent", "global_bounds", xml.alias("value"))


@operator("SINK-18")
def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").parquet(path)
