"""Projections: arithmetic of one voxel at a time, layers, coordinates and drawing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.registry import operator

LABELS = 65_535


@operator("PROJ-01")
def absolute(vox: DataFrame) -> DataFrame:
    return vox.withColumn("tgt", F.abs("tgt"))


@operator("PROJ-02")
def negative(vox: DataFrame) -> DataFrame:
    return vox.withColumn("tgt", F.lit(255.0) - F.col("tgt"))


@operator("PROJ-03")
def add_source(vox: DataFrame) -> DataFrame:
    return vox.withColumn("tgt", F.col("tgt") + F.col("src"))


@operator("PROJ-04")
def subtract_source(vox: DataFrame) -> DataFrame:
    return vox.withColumn("tgt", F.col("tgt") - F.col("src"))


@operator("PROJ-05")
def add(vox: DataFrame, value: float) -> DataFrame:
    return vox.withColumn("tgt", F.col("tgt") + F.lit(float(value)))


@operator("PROJ-06")
def multiply(vox: DataFrame, value: float | None = None) -> DataFrame:
    return vox.withColumn("tgt", F.col("tgt") * (F.col("src") if value is None else F.lit(float(value))))


@operator("PROJ-07")
def overlay(vox: DataFrame, alpha: float) -> DataFrame:
    return vox.withColumn("tgt", F.col("src") * alpha + F.col("tgt") * (1 - alpha))


@operator("PROJ-08")
def transparent_add(vox: DataFrame, other: DataFrame, value: str = "tgt") -> DataFrame:
    """Where the target is 0 it takes the other picture's value (0 where that has no voxel)."""
    o = other.select("z", "y", "x", F.col(value).alias("__other"))
    return vox.join(o, ["z", "y", "x"], "left").withColumn("tgt", F.when(F.col("tgt") == 0, F.coalesce("__other", F.lit(0.0))).otherwise(F.col("tgt"))).drop("__other")


@operator("PROJ-09")
def scale_colors(vox: DataFrame, low: float, high: float) -> DataFrame:
    """(target - low) * 255 / (high - low); null if the range is empty."""
    return vox.withColumn("tgt", F.try_divide((F.col("tgt") - low) * 255.0, F.lit(float(high - low))))


@operator("PROJ-10")
def crop_colors(vox: DataFrame) -> DataFrame:
    return vox.withColumn("tgt", F.least(F.greatest("tgt", F.lit(0.0)), F.lit(255.0)))


def grey(v: Column) -> Column:
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v + 0.5)))


@operator("PROJ-11")
def to_grey(vox: DataFrame) -> DataFrame:
    return vox.withColumn("tgt", grey(F.col("tgt")).cast("double"))


@operator("PROJ-12")
def copy_layer(vox: DataFrame, source: str = "tgt", target: str = "src") -> DataFrame:
    return vox.withColumn(target, F.col(source))


@operator("PROJ-13")
def swap_layers(vox: DataFrame, one: str = "src", two: str = "tgt") -> DataFrame:
    return vox.withColumns({one: F.col(two), two: F.col(one)})


@operator("PROJ-14")
def target_to_label(vox: DataFrame) -> DataFrame:
    return vox.withColumn("tis", F.least(F.greatest(F.floor(F.col("tgt") + 0.5), F.lit(0)), F.lit(LABELS)).cast("int"))


@operator("PROJ-15")
def merge_label(vox: DataFrame, label: int) -> DataFrame:
    """Where the target is positive the label is set, locked or not."""
    return vox.withColumn("tis", F.when(F.col("tgt") > 0, F.lit(label)).otherwise(F.col("tis")))


@operator("PROJ-16")
def label_to_target(vox: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """The label as a number; of a selection only its labels, the others 0."""
    value = F.col("tis").cast("double")
    return vox.withColumn("tgt", value if selected is None else F.when(F.col("tis").isin(selected), value).otherwise(0.0))


@operator("PROJ-17")
def assign(vox: DataFrame, patch: DataFrame, col: str, mask: Column | None = None) -> DataFrame:
    """Values of ``patch`` (z, y, x, col) replace those of voxels it names (and the mask admits)."""
    p = patch.select("z", "y", "x", F.col(col).alias("__new"))
    ok = F.col("__new").isNotNull() if mask is None else F.col("__new").isNotNull() & mask
    return vox.join(p, ["z", "y", "x"], "left").withColumn(col, F.when(ok, F.col("__new")).otherwise(F.col(col))).drop("__new").select(*vox.columns)


@operator("PROJ-17")
def padded(vox: DataFrame, col: str, h: int, w: int) -> DataFrame:
    """(z, y, x, col) with a border of zeros one voxel wide; the old first voxel is at (1, 1)."""
    shifted = vox.select("z", (F.col("y") + 1).alias("y"), (F.col("x") + 1).alias("x"), F.col(col))
    frame = vox.select("z").distinct().select("z", F.explode(F.sequence(F.lit(0), F.lit((h + 2) * (w + 2) - 1))).alias("i"))
    cells = frame.select("z", F.expr(f"CAST(i DIV {w + 2} AS INT)").alias("y"), F.expr(f"CAST(i % {w + 2} AS INT)").alias("x"))
    zero = F.lit(0).cast(dict(vox.dtypes)[col])
    return cells.join(shifted, ["z", "y", "x"], "left").withColumn(col, F.coalesce(col, zero))


@operator("PROJ-18")
def clear(vox: DataFrame, col: str) -> DataFrame:
    return vox.withColumn(col, F.lit(0).cast(dict(vox.dtypes)[col]))


@operator("PROJ-19")
def set_point(vox: DataFrame, col: str, z: int, y: int, x: int, value: float) -> DataFrame:
    here = (F.col("z") == z) & (F.col("y") == y) & (F.col("x") == x)
    return vox.withColumn(col, F.when(here, F.lit(value).cast(dict(vox.dtypes)[col])).otherwise(F.col(col)))


@operator("PROJ-19")
def flat_index(vox: DataFrame, w: int) -> DataFrame:
    return vox.withColumn("idx", F.col("x") + F.col("y") * w)


@operator("PROJ-20")
def layer(vox: DataFrame, col: str) -> DataFrame:
    return vox.select("z", "y", "x", col)


@operator("PROJ-21")
def with_mode(vox: DataFrame, src: int = 1, tgt: int = 1) -> DataFrame:
    """Range modes of the layers: 1 any, 2 from 0 to 255."""
    return vox.withColumns({"mode_src": F.lit(src), "mode_tgt": F.lit(tgt)})


@operator("PROJ-22")
def dims(vox: DataFrame) -> DataFrame:
    return vox.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), (F.max("z") - F.min("z") + 1).alias("n"), F.min("z").alias("start_z"), (F.max("z") + 1).alias("end_z"))


@operator("PROJ-22")
def active(vox: DataFrame, start: int, end: int) -> DataFrame:
    """Slices start to end - 1; over files partitioned by z only those are read."""
    return vox.where((F.col("z") >= start) & (F.col("z") < end))


@operator("PROJ-23")
def reslice(vox: DataFrame, axis: str, at: int, col: str = "src") -> DataFrame:
    """The plane across an axis: (row, col) are (z, y) for x, (z, x) for y and (y, x) for z."""
    rest = [c for c in ("z", "y", "x") if c != axis]
    return vox.where(F.col(axis) == at).select(F.col(rest[0]).alias("row"), F.col(rest[1]).alias("col"), F.col(col).alias("value"))


@operator("PROJ-24")
def swap_axes(vox: DataFrame, a: str, b: str) -> DataFrame:
    return vox.withColumns({a: F.col(b), b: F.col(a)})


@operator("PROJ-24")
def reverse_slices(vox: DataFrame, n: int) -> DataFrame:
    return vox.withColumn("z", F.lit(n - 1) - F.col("z"))


@operator("PROJ-25")
def transform_slices(vox: DataFrame, matrix: list[float], col: str = "src") -> DataFrame:
    """Resample every slice: the voxel at (x, y) takes the nearest of a 3x3 homogeneous inverse map, 0 outside."""
    a, b, c, d, e, f, g, h, i = map(float, matrix)
    den = F.col("x") * g + F.col("y") * h + i
    px = F.floor((F.col("x") * a + F.col("y") * b + c) / den + 0.5).cast("int")
    py = F.floor((F.col("x") * d + F.col("y") * e + f) / den + 0.5).cast("int")
    origin = vox.select("z", F.col("y").alias("__py"), F.col("x").alias("__px"), F.col(col).alias("__value"))
    asked = vox.withColumns({"__py": py, "__px": px})
    zero = F.lit(0).cast(dict(vox.dtypes)[col])
    return asked.join(origin, ["z", "__py", "__px"], "left").withColumn(col, F.coalesce("__value", zero)).select(*vox.columns)


def translation(dx: float, dy: float) -> list[float]:
    return [1, 0, -dx, 0, 1, -dy, 0, 0, 1]


def rotation(degrees: float, cx: float, cy: float) -> list[float]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return [c, s, cx - c * cx - s * cy, -s, c, cy + s * cx - c * cy, 0, 0, 1]


def scaling(sx: float, sy: float, cx: float = 0, cy: float = 0) -> list[float]:
    return [1 / sx, 0, cx - cx / sx, 0, 1 / sy, cy - cy / sy, 0, 0, 1]


def shear(kx: float, ky: float) -> list[float]:
    det = 1 - kx * ky
    return [1 / det, -kx / det, 0, -ky / det, 1 / det, 0, 0, 0, 1]


def flip(axis: str, size: int) -> list[float]:
    return [-1, 0, size - 1, 0, 1, 0, 0, 0, 1] if axis == "x" else [1, 0, 0, 0, -1, size - 1, 0, 0, 1]


@operator("PROJ-26")
def reorient(vox: DataFrame, given: str, desired: str, sizes: dict[str, int]) -> DataFrame:
    """From one anatomical orientation to another, such as RAS to PSL: axes are permuted and flipped."""
    pairs = {"R": 0, "L": 0, "A": 1, "P": 1, "S": 2, "I": 2}
    axes, out = ("x", "y", "z"), {}
    for target, letter in zip(axes, desired, strict=True):
        k = next(i for i, g in enumerate(given) if pairs[g] == pairs[letter])
        source = axes[k]
        out[target] = F.col(source) if given[k] == letter else F.lit(sizes[source] - 1) - F.col(source)
    return vox.withColumns(out)


@operator("PROJ-27")
def to_world(points: DataFrame, transform: list[float]) -> DataFrame:
    """wx, wy, wz of (x, y, z) by the first three lines of a 4x4 matrix."""
    t = [float(v) for v in transform]
    return points.withColumns({n: F.col("x") * t[4 * i] + F.col("y") * t[4 * i + 1] + F.col("z") * t[4 * i + 2] + t[4 * i + 3] for i, n in enumerate(("wx", "wy", "wz"))})


def padding_transform(transform: list[float], low: tuple[int, int, int], spacing: tuple[float, float, float]) -> list[float]:
    """The matrix after ``low`` voxels are added before each axis (negative: removed)."""
    out = list(map(float, transform))
    for i in range(3):
        out[4 * i + 3] -= sum(out[4 * i + j] * low[j] * spacing[j] for j in range(3))
    return out


@operator("PROJ-28")
def brush(vox: DataFrame, col: str, cx: int, cy: int, radius: float, value: float, z: int | None = None, dx: float = 1, dy: float = 1, erase: bool = False, over: float = 0, locked: list[int] | None = None) -> DataFrame:
    """Paint the disk of a radius in millimetres (erase: what has the value there becomes ``over``); locks hold."""
    disk = F.pow((F.col("x") - cx) * float(dx), 2) + F.pow((F.col("y") - cy) * float(dy), 2) <= float(radius) ** 2
    if z is not None:
        disk = disk & (F.col("z") == z)
    if locked:
        disk = disk & ~F.col("tis").isin(locked)
    kind = dict(vox.dtypes)[col]
    if erase:
        disk, new = disk & (F.col(col) == value), F.lit(over)
    else:
        new = F.lit(value)
    return vox.withColumn(col, F.when(disk, new.cast(kind)).otherwise(F.col(col)))


@operator("PROJ-29")
def line_points(lines: DataFrame) -> DataFrame:
    """(id, k, x, y): the voxels of the straight line from (x0, y0) to (x1, y1), one for each step of the longer side."""
    steps = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    k = lines.withColumn("n", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))

    def at(a: str, b: str) -> Column:
        return F.when(F.col("n") == 0, F.col(a)).otherwise(F.col(a) + F.floor((2 * F.col("k") * (F.col(b) - F.col(a)) + F.col("n")) / (2 * F.col("n")))).cast("int")

    return k.select("id", "k", at("x0", "x1").alias("x"), at("y0", "y1").alias("y"))


@operator("PROJ-30")
def color_lookup(vox: DataFrame, lut: DataFrame) -> DataFrame:
    """r, g, b of the label from (id, r, g, b); lookup tables hold at most one row a label."""
    return vox.join(F.broadcast(lut.select(F.col("id").alias("tis"), "r", "g", "b").limit(LABELS + 1)), "tis", "left")


@operator("PROJ-31")
def to_hsl(colors: DataFrame) -> DataFrame:
    """h, s, l (0 to 1) of r, g, b (0 to 1)."""
    hi, lo = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    d, light = hi - lo, (hi + lo) / 2
    sat = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - hi - lo)).otherwise(d / (hi + lo))
    hue = (
        F.when(d == 0, 0.0)
        .when(hi == F.col("r"), (F.col("g") - F.col("b")) / d + F.when(F.col("g") < F.col("b"), 6.0).otherwise(0.0))
        .when(hi == F.col("g"), (F.col("b") - F.col("r")) / d + 2)
        .otherwise((F.col("r") - F.col("g")) / d + 4)
    )
    return colors.withColumns({"h": hue / 6, "s": sat, "l": light})


@operator("PROJ-31")
def from_hsl(colors: DataFrame) -> DataFrame:
    def channel(offset: float) -> Column:
        q = F.when(F.col("l") < 0.5, F.col("l") * (1 + F.col("s"))).otherwise(F.col("l") + F.col("s") - F.col("l") * F.col("s"))
        p = F.col("l") * 2 - q
        t = F.pmod(F.col("h") + offset, F.lit(1.0))
        return F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (F.lit(2 / 3) - t) * 6).otherwise(p)

    return colors.withColumns({"r": channel(1 / 3), "g": channel(0.0), "b": channel(-1 / 3)})


@operator("PROJ-32")
def erase(vox: DataFrame, mask: Column, col: str = "tgt", locked: list[int] | None = None) -> DataFrame:
    """Masked voxels become 0; labels that are locked stay."""
    if col == "tis" and locked:
        mask = mask & ~F.col("tis").isin(locked)
    return vox.withColumn(col, F.when(mask, F.lit(0).cast(dict(vox.dtypes)[col])).otherwise(F.col(col)))


@operator("PROJ-33")
def shift(vox: DataFrame, dx: int, dy: int, h: int, w: int, col: str = "tis") -> DataFrame:
    """A layer moved by an offset; what leaves the slice is lost and what comes in is 0."""
    return transform_slices(vox, translation(dx, dy), col)


@operator("SCAN-03")
def grey_weights(colors: DataFrame, red: float = 0.299, green: float = 0.587, blue: float = 0.114) -> DataFrame:
    return colors.withColumn("grey", F.col("r") * red + F.col("g") * green + F.col("b") * blue)


@operator("SCAN-19")
def channel(pixels: DataFrame, k: int) -> DataFrame:
    """The k-th channel (from 0) of an array column as source values."""
    return pixels.select("z", "y", "x", F.element_at("channels", k + 1).cast("double").alias("src"))
