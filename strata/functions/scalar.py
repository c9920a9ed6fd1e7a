"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from strata.registry import operator


@operator("SCALAR-01")
def lower_name(name: Column) -> Column:
    return F.lower(name)


@operator("SCALAR-02")
def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


@operator("SCALAR-02")
def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(dist2(ax, ay, bx, by).cast("double"))


@operator("SCALAR-02")
def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


@operator("SCALAR-02")
def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


@operator("SCALAR-02")
def cross_2d(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.abs(ax * by - ay * bx)


@operator("SCALAR-02")
def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


@operator("SCALAR-03")
def next_odd(v: Column) -> Column:
    up = F.ceil(v)
    return F.when(up % 2 == 0, up + 1).otherwise(up)


@operator("SCALAR-03")
def round_up(v: Column, step: float) -> Column:
    return F.ceil(v / step) * step


@operator("SCALAR-03")
def round_down(v: Column, step: float) -> Column:
    return F.floor(v / step) * step


@operator("SCALAR-04")
def transform_point(t: list[float], x: Column, y: Column, z: Column) -> list[Column]:
    return [x * float(t[4 * i]) + y * float(t[4 * i + 1]) + z * float(t[4 * i + 2]) + float(t[4 * i + 3]) for i in range(3)]


@operator("SCALAR-05")
def dicom_date(year: Column, month: Column, day: Column) -> Column:
    """YYYYMMDD; empty if a part is 0."""
    return F.when((year == 0) | (month == 0) | (day == 0), "").otherwise(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


@operator("SCALAR-05")
def dicom_time(hour: Column, minute: Column, second: Column, as_coded: bool = False) -> Column:
    """HHMMSS; as coded, empty if a part is 0."""
    text = F.concat(*[F.lpad(c.cast("string"), 2, "0") for c in (hour, minute, second)])
    return F.when((hour == 0) | (minute == 0) | (second == 0), "").otherwise(text) if as_coded else text


@operator("SCALAR-05")
def replace_text(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


@operator("SCALAR-05")
def backslash_joined(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), "\\")


@operator("SCALAR-06")
def tokens(line: Column, delimiter: str) -> Column:
    return F.filter(F.split(line, f"\\Q{delimiter}\\E"), lambda t: t != "")


@operator("SCALAR-06")
def is_integer(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+$")


@operator("SCALAR-07")
def decimal_string(text: Column) -> Column:
    return F.trim(text).try_cast("double")


@operator("SCALAR-07")
def decimal_strings(text: Column) -> Column:
    return F.transform(F.split(text, r"\\"), lambda t: F.trim(t).try_cast("double"))


@operator("SCALAR-07")
def integer_string(text: Column) -> Column:
    return F.trim(text).try_cast("int")


@operator("SCALAR-08")
def pack_versions(version: Column, tissues: Column) -> Column:
    return F.shiftleft(tissues, 8).bitwiseOR(version)


@operator("SCALAR-08")
def unpack_versions(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND(F.lit(255)), F.shiftright(packed, 8)


@operator("SCALAR-09")
def dispatched(mode: Column, cases: dict[str, Column], other: Column) -> Column:
    out = other
    for name, value in cases.items():
        out = F.when(mode == name, value).otherwise(out)
    return out


@operator("UDF-01")
def register(spark: SparkSession) -> list[str]:
    """Make functions known to SQL; gives their names."""
    from pyspark.sql.types import DoubleType

    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION grey_level(v DOUBLE) RETURNS DOUBLE RETURN floor(least(255.0D, greatest(0.0D, v + 0.5D)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION next_odd(v DOUBLE) RETURNS BIGINT RETURN ceil(v) + CASE WHEN ceil(v) % 2 = 0 THEN 1 ELSE 0 END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION distance_2d(ax DOUBLE, ay DOUBLE, bx DOUBLE, b_y DOUBLE) RETURNS DOUBLE RETURN sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))")
    del DoubleType
    return ["grey_level", "next_odd", "distance_2d"]
