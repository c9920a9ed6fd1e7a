"""Queries read whole tables, beyond the cuts that the registered SQL still has."""

from __future__ import annotations

import os

import duckdb
import pytest

from strata.plans import catalogue

SF = "/root/testdata/sf0.01"
MARKED = [
    "join10_all_marks", "join11_remove_mark", "join12_add_strokes", "join13_match_objects", "set03_undirected", "agg14_distances", "agg14_angles", "proj29_line_points", "geom04_extruded",
    "scalar02_vectors", "scalar03_rounding", "scalar04_transform", "scalar05_dates", "scalar06_tokens", "scalar07_decimals", "scalar08_versions", "scalar09_dispatch",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(table) -> tuple[list[str], list[tuple]]:
    cols = sorted(table.column_names)
    plain = lambda v: v + 0.0 if isinstance(v, float) else v
    return cols, sorted((tuple(map(plain, r)) for r in zip(*[table[c].to_pylist() for c in cols], strict=True)), key=repr)


def whole(sql: str, *cuts: str) -> str:
    """The registered SQL without its cuts."""
    for cut in (" WHERE o_orderkey <= 4000", *cuts):
        sql = sql.replace(cut, "")
    return sql


@pytest.mark.parametrize("name", MARKED)
def test_marks_are_whole(spark, duck, name):
    found = duck.sql(whole(catalogue.oracle_sql()[name])).arrow()
    assert rows(catalogue.queries()[name](spark, SF).toArrow()) == rows(found.read_all() if hasattr(found, "read_all") else found)


@pytest.mark.parametrize(("name", "cut"), [("join14_mutual_nearest", " AND a.seq < 500 AND b.seq < 500"), ("agg16_softmax", " WHERE seq < 1000"), ("graph29_edge_components", "seq < 300 AND ")])
def test_pairs_groups_and_edges_are_whole(spark, duck, name, cut):
    found = duck.sql(whole(catalogue.oracle_sql()[name], cut)).arrow()
    assert rows(catalogue.queries()[name](spark, SF).toArrow()) == rows(found.read_all() if hasattr(found, "read_all") else found)


def test_polylines_hold_every_edge(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()
    edges = {(min(p), max(p)) for p in ((r[0] % 200, r[1] % 200) for r in orders) if p[0] != p[1]}
    lines = {}
    for r in catalogue.queries()["graph29_polylines"](spark, SF).collect():
        lines.setdefault((r["label"], r["line"]), {})[r["k"]] = r["node"]
    steps = [(min(v[k], v[k + 1]), max(v[k], v[k + 1])) for v in lines.values() for k in range(len(v) - 1)]
    assert len(steps) == len(set(steps)) and set(steps) == edges


def test_mutual_nearest_of_scattered_points(spark):
    import random

    from strata.operators import labels

    rng = random.Random(4)
    one = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(200)] + [(900, 500.0, -800.0), (901, 500.0, -800.0)]
    two = [(i, rng.gauss(30, 1), rng.gauss(0, 9)) for i in range(150)] + [(800, -5000.0, 3.0)]
    d = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    to = {p[0]: min(two, key=lambda q, p=p: (d(p, q), q[0]))[0] for p in one}
    back = {q[0]: min(one, key=lambda p, q=q: (d(p, q), p[0]))[0] for q in two}
    frames = [spark.createDataFrame(r, "id long, cx double, cy double") for r in (one, two)]
    assert sorted(map(tuple, labels.mutual_nearest(*frames).collect())) == sorted((a, b) for a, b in to.items() if back[b] == a)
    assert labels.mutual_nearest(frames[0], frames[1].limit(0)).count() == 0


#: What is fast enough for a test; thinning and the others that are slow run on the same whole views.
SLICED = ["graph21_fuzzy", "graph22_fast_marching", "udf04_threshold_level_set", "proj27_to_world"]


@pytest.mark.parametrize("name", SLICED)
def test_image_queries_hold_every_voxel(spark, name):
    small = "/root/testdata/sf0.001"
    got = catalogue.queries()[name](spark, small).select("z", "y", "x").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, catalogue.img(spark, small).select("z", "y", "x").collect()))


def test_proj27_is_whole(spark, duck):
    found = duck.sql(whole(catalogue.oracle_sql()["proj27_to_world"], " WHERE x < 8")).arrow()
    assert rows(catalogue.queries()["proj27_to_world"](spark, SF).toArrow()) == rows(found.read_all() if hasattr(found, "read_all") else found)


def test_skeleton_graph_and_contours_are_whole(spark):
    small = "/root/testdata/sf0.001"
    on = {(r["z"], r["y"], r["x"]) for r in catalogue.li(spark, small).where("src > 120").collect()}
    size = (max(z for z, _, _ in on) + 1, 64, 64)
    got = {tuple(r) for r in catalogue.queries()["graph28_skeleton_graph"](spark, small).collect()}
    flat = lambda z, y, x: (z * size[1] + y) * size[2] + x
    steps = {(flat(*p), flat(*q)) for p in on for q in ((p[0] + 1, p[1], p[2]), (p[0], p[1] + 1, p[2]), (p[0], p[1], p[2] + 1)) if q in on}
    assert steps <= got
    zs = {r["z"] for r in catalogue.layers(spark, SF).where("tis > 0").select("z").distinct().collect()}
    assert {r["z"] for r in catalogue.queries()["geom01_contours"](spark, SF).collect()} == zs


def test_thresholds_are_guessed_from_all_seeds(spark):
    from pyspark.sql import functions as F

    from strata.operators import plugins

    vox = spark.range(150_000).select(F.lit(0).alias("z"), (F.col("id") / 500).cast("int").alias("y"), (F.col("id") % 500).cast("int").alias("x"), F.col("id").cast("double").alias("src"))
    got = plugins.guessed_thresholds(vox, vox).first()
    mean, dev = 149_999 / 2, ((150_000**2 - 1) / 12) ** 0.5
    assert got["low"] == pytest.approx(mean - 2 * dev) and got["high"] == pytest.approx(mean + 2 * dev)
