"""Hand-derived fixtures."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata import grid
from strata.operators import aggregate, geometry, kernels, labels, point, predicate, region, window
from strata.sources import files, formats
from strata.streaming import tracking


def row(spark, values, col="src", tis=None):
    data = [(0, 0, x, float(v), float(v), int((tis or [0] * len(values))[x])) for x, v in enumerate(values)]
    return spark.createDataFrame(data, grid.VOX)


def line(df, col):
    return [r[0] for r in df.orderBy("x").select(col).collect()]


def test_threshold(spark):
    assert line(predicate.threshold(row(spark, [10, 60, 61, 120, 121]), [60, 120]), "tgt") == [0, 0, 127.5, 127.5, 255]
    assert line(predicate.threshold(row(spark, [1, 2]), []), "tgt") == [1, 2]


def test_histogram(spark):
    df = row(spark, [-0.5, 0, 0.9, 255.9, 256])
    assert {r["bin"]: r["n"] for r in aggregate.histogram(df).collect()} == {0: 2, 255: 1}
    assert {r["bin"]: r["n"] for r in aggregate.histogram(df, clamp=True).collect()} == {0: 3, 255: 2}
    assert aggregate.out_of_range(df).first()["n"] == 2


def test_labels(spark):
    df = row(spark, [0] * 4, tis=[0, 1, 2, 3])
    assert line(labels.remove_label(df, 2), "tis") == [0, 1, 0, 2]
    t = spark.createDataFrame([(i,) for i in (1, 2, 3)], "id int")
    assert line(labels.remove_labels(df, t, t.where("id = 2")), "tis") == [0, 1, 0, 2]
    assert line(predicate.cap_label(row(spark, [0] * 3, tis=[1, 5, 9]), 5), "tis") == [1, 5, 0]
    assert line(point.target_to_label(row(spark, [-1, 0.4, 0.5, 70000])), "tis") == [0, 0, 1, 65535]
    f = row(spark, [7, 7, 7], tis=[0, 1, 2])
    assert line(predicate.add_label(f, 7, 7.0), "tis") == [7, 1, 2]
    assert line(predicate.add_label(f, 7, 7.0, True, [2]), "tis") == [7, 7, 2]


def test_interpolate(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 0), (4, 0, 0, 8.0, 8.0, 0)], grid.VOX)
    assert [r["value"] for r in window.interpolate(df, 0, 4).orderBy("z").collect()] == [2, 4, 6]


def test_median_and_erosion():
    a = np.arange(9.0).reshape(3, 3)
    assert kernels.median3(a)[1, 1] == 4 and kernels.interquartile3(a)[1, 1] == 6 and kernels.median3(a)[0, 1] == 1
    assert kernels.erode(np.array([[5.0, 5, 0, 5]]), 1).tolist() == [[5, 0, 0, 0]]


def test_features_and_measures(spark):
    one = aggregate.window_features(row(spark, [3]), 0, 0, 0, 0).first()
    assert (one["mean"], one["stddev"], one["least"], one["largest"]) == (3, 1e10, 3, 3)
    pair = spark.createDataFrame([(0, 0, 0, 3, 4, 0)], "x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    d = aggregate.distances(pair, 1, 1, 1).first()
    assert d["distance"] == 5 and d["thickness"] == pytest.approx(41**0.5)


def test_kmeans_start_and_classes(spark):
    assert aggregate.start_centers([0.0], [30.0], 2) == [[30.0], [0.0]]
    out = aggregate.apply_centers(row(spark, [0, 10, 20, 30]), ["src"], [[30.0], [0.0]])
    assert line(out, "tgt") == [255, 255, 0, 0]


def test_next_slice(spark):
    df = spark.createDataFrame([(z, 0, 0, 0.0, 0.0, int(z == 1)) for z in range(5)], grid.VOX)
    assert predicate.next_slice_with(df, 1, 2).first()["z"] == 1
    assert predicate.next_slice_with(df, 9, 2).first() is None


def test_brush():
    y, x = np.mgrid[0:512, 0:512]
    for dy, r, n in ((1.0, 0, 1), (1.0, 1, 5), (0.2, 0, 1)):
        assert ((x - 120) ** 2 + (dy * (y - 120)) ** 2 <= r * r).sum() == n


def test_connectivity_graphs():
    for points, n in (([(8, 10, 9), (8, 11, 9), (9, 11, 9)], 2), ([(5, 5, 5), (5, 6, 6), (5, 7, 7), (5, 8, 8), (5, 9, 8), (5, 9, 9)], 5)):
        on = np.zeros((45, 70, 50), dtype=bool)
        for p in points:
            on[p] = True
        assert len(kernels.skeleton_edges(on)) == n


def test_skeleton_graph_of_full_slices(spark):
    """All voxels on: the pairs along the axes, in seconds; and on a few voxels the rule, pair by pair."""
    began = time.monotonic()
    full = spark.range(7 * 64 * 64).selectExpr("CAST(id DIV 4096 + 1 AS INT) AS z", "CAST(id DIV 64 % 64 AS INT) AS y", "CAST(id % 64 AS INT) AS x", "1.0D AS tgt")
    assert region.skeleton_graph(full).count() == 6 * 4096 + 2 * 7 * 63 * 64 and time.monotonic() - began < 60
    rng = np.random.default_rng(3)
    on = rng.random((5, 6, 7)) < 0.3
    points = list(map(tuple, np.argwhere(on).tolist()))
    apart = lambda p, q: sum(abs(a - b) for a, b in zip(p, q, strict=True))
    near = lambda p, q: max(abs(a - b) for a, b in zip(p, q, strict=True)) == 1
    flat = lambda p: int(np.ravel_multi_index(p, (5, *(np.argwhere(on)[:, 1:].max(0) + 1))))
    want = {(flat(p), flat(q)) for p in points for q in points if p < q and near(p, q) and not any(near(p, r) and near(r, q) and max(apart(p, r), apart(r, q)) < apart(p, q) for r in points)}
    df = spark.createDataFrame([(*p, 1.0) for p in points], "z int, y int, x int, tgt double")
    assert sorted(map(tuple, region.skeleton_graph(df).collect())) == sorted(want)


def test_connected_interpolation():
    a, b = np.zeros((512, 512), dtype=bool), np.zeros((512, 512), dtype=bool)
    a[200, 200], b[200, 250] = True, True
    for m in kernels.connected_between(a, b, 2):
        y, x = np.argwhere(m)[0]
        assert m.any() and 210 < x < 240 and y == 200


def test_directions_and_weights():
    assert kernels.turn_cost((1, 0, 0), (1, 0, 0)) == pytest.approx(0)
    assert kernels.turn_cost((1, 0, 0), (0, 1, -1)) == pytest.approx(1)
    assert kernels.turn_cost((1, 0, 0), (-1, 0, 0)) == pytest.approx(2)
    a = np.zeros((1, 1, 3))
    assert kernels.edge_weight(a, (0, 0, 1), (0, 0, 2), (0, 0, 0), (0, 0, 2), (1, 1, 1), 1, 1) == 1


def test_padding_transform():
    c = [np.array([0.1, 0.9, 0.1]), np.array([0.9, -0.1, 0.1])]
    c = [v / np.linalg.norm(v) for v in c]
    t = formats.matrix([v.tolist() for v in [*c, np.cross(*c)]], [3.4, -10, 2.5])
    there = point.padding_transform(t, (-1, -2, -3), (1, 2, 3))
    assert point.padding_transform(there, (1, 2, 3), (1, 2, 3)) == pytest.approx(t)


@pytest.mark.parametrize("kind", ["mha", "nrrd", "gz", "vti"])
def test_volume_round_trip(spark, tmp_path, kind):
    data = [(z, y, x, float(x + 4 * y + 28 * z), 0.0, 0) for z in range(3) for y in range(7) for x in range(4)]
    df = spark.createDataFrame(data, grid.VOX)
    t = None if kind == "vti" else formats.matrix([[0, 1, 0], [1, 0, 0], [0, 0, -1]], [3.5, -10, 2.5])
    assert files.save_files(files.encoded(df, kind, spacing=(0.5, 1.0, 2.0), transform=t), str(tmp_path)) == 1
    back = files.read_volumes(spark, f"{tmp_path}/volume.*")
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted((z, y, x, v) for z, y, x, v, _, _ in data)
    info = files.volume_info(spark, f"{tmp_path}/volume.*").first()
    assert (info["w"], info["h"], info["n"], info["dx"], info["dy"], info["dz"]) == (4, 7, 3, 0.5, 1, 2)
    assert info["tr"] == pytest.approx(t or formats.IDENTITY)
    assert files.read_volumes(spark, f"{tmp_path}/volume.*", z=(2, 3)).count() == 28


@pytest.mark.parametrize("kind", ["bmp", "png", "raw"])
def test_slices_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(z, y, x, float(x * 3 + y + z), 0.0, 0) for z in range(2) for y in range(5) for x in range(6)], grid.VOX)
    files.save_files(files.encoded(df, kind), str(tmp_path))
    back = files.read_raw(spark, f"{tmp_path}/*0.raw", 6, 5, "f4") if kind == "raw" else files.read_images(spark, f"{tmp_path}/*.{kind}")
    want = df.where("z = 0") if kind == "raw" else df
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(tuple(r)[:4] for r in want.collect())


def test_colour_png():
    rgb = np.zeros((16, 32, 3))
    rgb[:] = (1, 234, 171)
    back = formats.read_png(formats.write_png(rgb))
    assert back.shape == (16, 32, 3) and back[0, 0, 1] == 234


def test_markers(spark, tmp_path):
    p = tmp_path / "m.pts"
    p.write_text("Version 1.0\n2\nleft knee 2.0 4.0 6.0\nX 900 -5 1\n")
    got = [tuple(r) for r in files.read_markers(spark, str(p), formats.IDENTITY, (1, 2, 3), (10, 10, 10)).collect()]
    assert got == [("left knee", 2, 2, 2), ("X", 9, 0, 0)]


def test_tissue_list_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, "Fat", 1.0, 0.5, 0.25, 0.5, False), (2, "Grey matter", 0.0, 0.0, 1.0, 0.75, False)], "id int, name string, r double, g double, b double, opac double, locked boolean")
    files.write_lines(files.tissue_lines(t), str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tissues(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, t.collect()))


def test_contours_and_hierarchy(spark, tmp_path):
    (tmp_path / "c.txt").write_text("S0\nT3\nO1\n3: 1,2 3,4 5,6\nI1\n1: 9,9\nS1\nT4\nO1\n1: 7,8\n")
    got = [(r["z"], r["tissue"], r["outer"], len(r["points"])) for r in files.read_contours(spark, str(tmp_path / "c.txt")).collect()]
    assert got == [(0, 3, True, 3), (0, 3, False, 1), (1, 4, True, 1)]
    (tmp_path / "h.xml").write_text('<h><folder name="Head"><tissue name="Brain"/><folder name="Bones"><tissue name="Skull"/></folder></folder></h>')
    got = [(r["id"], r["parent"], r["name"], r["is_folder"]) for r in files.read_hierarchy(spark, str(tmp_path / "h.xml")).collect()]
    assert got == [(0, None, "Head", True), (1, 0, "Brain", False), (2, 0, "Bones", True), (3, 2, "Skull", False)]


def test_store_prunes_slices(spark, tmp_path):
    df = spark.createDataFrame([(z, y, x, 1.2, 2.4, 0) for z in range(4) for y in range(2) for x in range(2)], grid.VOX)
    files.write_store(df, str(tmp_path / "s"))
    part = files.read_store(spark, str(tmp_path / "s"), (1, 3), ["z", "src"])
    assert part.count() == 8
    assert "PartitionFilters: [isnotnull(z" in part._jdf.queryExecution().executedPlan().toString()
    assert files.merge_projects([df, df]).agg(F.max("z")).first()[0] == 7
    back = files.resized(files.resized(df, (2, 2, 4), (1, 2, 1), (1, 0, 1)), (4, 4, 6), (-1, -2, -1), (-1, 0, -1))
    assert sorted(map(tuple, back.collect())) == sorted((r["z"], r["y"], r["x"], r["src"]) for r in df.collect())


def test_voxelise_box(spark):
    p = [(1, 1, 1), (5, 1, 1), (5, 4, 1), (1, 4, 1), (1, 1, 3), (5, 1, 3), (5, 4, 3), (1, 4, 3)]
    quads = [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 5, 4), (3, 2, 6, 7), (0, 3, 7, 4), (1, 2, 6, 5)]
    tris = [(a, b, c) for q in quads for a, b, c in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    rows = [(i, *(float(v) for k in t for v in p[k])) for i, t in enumerate(tris)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    got = {tuple(r) for r in files.voxelise(df, 10, 10).collect()}
    assert got == {(z, y, x) for z in (1, 2) for y in (1, 2, 3) for x in range(1, 6)}


def test_regions(spark):
    a = np.zeros((7, 7))
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    assert kernels.fill_holes(a > 0, 2)[3, 3] and not kernels.fill_holes(a > 0, 1)[3, 3]
    assert kernels.components(a, False, a > 0).max() == 0
    basins, merges = kernels.watershed(np.array([[1.0, 5, 2, 9, 0]]))
    assert len(np.unique(basins)) == 3 and len(merges) == 2
    df = spark.createDataFrame([(z, y, x, 0.0, float(x != 1 or z == 1), 0) for z in range(3) for y in range(2) for x in range(3)], grid.VOX)
    assert region.components_3d(df).where("comp >= 0").select("comp").distinct().count() == 1
    thin = kernels.thin(np.pad(np.ones((3, 20), dtype=bool), 2))
    assert kernels.components(thin.astype(int), True, thin).max() == 0 and 10 < thin.sum() < 25


def test_geometry():
    assert geometry.simplified([(0, 0), (5, 0.1), (10, 0)], 1.0) == [0, 2]
    assert geometry.simplified([(0, 0), (5, 3), (10, 0)], 1.0) == [0, 1, 2]
    on = np.zeros((6, 6), dtype=bool)
    on[1:4, 1:4] = True
    assert {tuple(p) for p in geometry.trace(on)[0].tolist()} == {(y, x) for y in range(1, 4) for x in range(1, 4)} - {(2, 2)}


def test_tracking(spark, tmp_path):
    df = spark.createDataFrame([(1, k, 5.0) for k in range(6)], "id int, k int, v double")
    out = tracking.track(df, "id", "k", ["v"]).orderBy("k").collect()
    assert out[-1]["e_v"] == pytest.approx(5.0) and out[-1]["difference"] == pytest.approx(0)
    v = tracking.Versions(spark, str(tmp_path / "v"))
    for n in (1, 2, 3):
        v.save(spark.range(n))
    assert v.undo().count() == 2 and v.undo().count() == 1 and v.redo().count() == 2
    v.save(spark.range(9))
    assert v.redo().count() == 9 and v.undo().count() == 2


def test_tracking_stream(spark, tmp_path):
    for part in (range(0, 3), range(3, 6)):
        spark.createDataFrame([(1, int(k), 2.0 * k) for k in part], "id int, k long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("id int, k long, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracking.track_stream(rows, "id", "k", ["v"]).writeStream.format("memory").queryName("tracked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tracked").count() == 6


@pytest.mark.parametrize("dtype", ["u1", "i2", "f4", "f8"])
@pytest.mark.parametrize("kind", ["vtk", "vtkb", "am"])
def test_text_volumes_give_back_values_and_place(kind, dtype):
    a = (np.arange(84).reshape(3, 7, 4) * (1 if dtype in ("u1", "i2") else 0.1)).astype(dtype)
    transform = list(formats.IDENTITY)
    transform[3], transform[7], transform[11] = 3.5, -10.0, 2.5
    back = formats.read_volume("v.am" if kind == "am" else "v.vtk", formats.WRITERS[kind](formats.Volume({"src": a}, (0.5, 1.0, 2.0), transform)))
    assert back.first.dtype.str[1:] == dtype and np.array_equal(back.first, a)
    assert back.spacing == (0.5, 1.0, 2.0) and back.transform == transform


def test_objects_of_one_place_meet_as_one(spark):
    """A slice's 40,000 objects at one place, and few others: in seconds, as the few by all pairs."""
    began = time.monotonic()
    crowd = spark.range(80_000).selectExpr("CAST(id DIV 40000 AS INT) AS z", "id % 40000 AS id", "1.0D AS cx", "2.0D AS cy", "id % 3 AS size")
    got = labels.match_objects(crowd, 3.0).groupBy("next_id", "score").count().collect()
    assert sorted((r["next_id"], r["score"]) for r in got) == [(0, 0.0), (1, 0.0), (2, 0.0)] and time.monotonic() - began < 60
    rng = np.random.default_rng(5)
    few = [(int(z), i, float(x), float(y), int(s)) for i, (z, x, y, s) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 9, 200) / 2, rng.integers(0, 9, 200) / 2, rng.integers(0, 4, 200), strict=True))]
    want = []
    for z, i, x, y, s in few:
        met = [(np.hypot(x - u, y - v) + abs(s - t), j) for c, j, u, v, t in few if c == z + 1 and np.hypot(x - u, y - v) <= 1.0]
        want += [(z, i, min(met)[1])] if met else []
    df = spark.createDataFrame(few, "z int, id long, cx double, cy double, size long")
    assert sorted(tuple(r)[:3] for r in labels.match_objects(df, 1.0).collect()) == sorted(want)


def test_thinning_of_many_slices_is_quick():
    """40 slices in seconds; a point goes by the rule that looks at its block."""
    rng = np.random.default_rng(6)

    def plainly(on):
        a, changed = np.pad(on, 1), True
        while changed:
            changed = False
            for s in kernels.steps_of(on.ndim, False):
                for p in np.argwhere(a & ~kernels.moved(a, s, False)).tolist():
                    block = a[tuple(slice(v - 1, v + 2) for v in p)]
                    if block.sum() > 2 and kernels.simple_point(block):
                        a[tuple(p)], changed = False, True
        return a[(slice(1, -1),) * on.ndim]

    for shape in ((9, 12), (1, 7), (4, 5, 4)):
        for share in (0.5, 0.8, 1.0):
            on = rng.random(shape) < share
            assert np.array_equal(kernels.thin(on), plainly(on))
    began = time.monotonic()
    for _ in range(40):
        kernels.thin(rng.random((50, 64)) < 0.7)
    assert time.monotonic() - began < 20


def test_no_file_is_missed(spark, tmp_path, monkeypatch):
    """Files are made once and all arrive, whatever the local iterator yields; what is lost is an error."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda self, *a, **b: iter(()))
    vox = spark.createDataFrame([(z, y, x, float(x + y + z), 0.0, 0) for z in range(5) for y in range(3) for x in range(4)], grid.VOX)
    assert files.save_files(files.encoded(vox, "vtk"), str(tmp_path)) == 1 and files.read_volumes(spark, f"{tmp_path}/*.vtk").count() == 60
    assert files.save_files(files.encoded(vox, "raw"), str(tmp_path)) == 5 and len(list(tmp_path.glob("*.raw"))) == 5
    monkeypatch.setattr(spark.sparkContext, "runJob", lambda *a, **b: [])
    with pytest.raises(RuntimeError, match="0 of 5 files"):
        files.save_files(files.encoded(vox, "raw"), str(tmp_path))


def test_unassigned_value_follows_the_range(spark):
    for values, want in (([0, 255], 127.5), ([255, 255], 0.0), ([0, 254], 255.0), ([0, 100, 255], 177.5)):
        assert region.unassigned_value(row(spark, values, "tgt"), "tgt").first()[0] == want
