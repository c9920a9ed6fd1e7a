"""Components, growing, filling, watershed, optimal paths and skeletons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.grid import per_slice, per_volume
from strata.operators import kernels as K
from strata.registry import operator


@operator("GRAPH-01")
def components(vox: DataFrame, col: str = "tgt", full: bool = False, masked: bool = False) -> DataFrame:
    """``comp`` in each slice: components of equal values from 0 in order of their first voxel; with ``masked`` zeros
    have none (-1)."""
    return per_slice(vox.withColumn("comp", F.lit(-1).cast("long")), lambda a: K.components(a, full, a != 0 if masked else None), [col], "comp")


@operator("GRAPH-02")
def components_3d(vox: DataFrame, col: str = "tgt", full: bool = True, key: str | None = None) -> DataFrame:
    """``comp`` over the whole volume, of what isn't 0. Slices are labelled one by one; the labels that touch across
    slices are a small table, which is resolved and joined back."""
    flat = components(vox, col, full, masked=True).withColumn("node", F.when(F.col("comp") >= 0, F.col("z").cast("long") * (1 << 32) + F.col("comp")))
    on = flat.where("node is not null").select("z", "y", "x", "node")
    shifts = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)] if full else [(0, 0)]
    moves = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in shifts]))
    below = on.withColumn("m", moves).select((F.col("z") + 1).alias("z"), (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), F.col("node").alias("below"))
    edges = on.join(below, ["z", "y", "x"]).select(F.col("node").alias("src"), F.col("below").alias("dst")).distinct()
    labels = propagate(edges)
    out = flat.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node")).drop("label", "node", "comp")
    dense = out.where("root is not null").select("root").distinct().withColumn("comp", F.row_number().over(Window.orderBy("root")) - 1)
    return out.join(dense, "root", "left").withColumn("comp", F.coalesce("comp", F.lit(-1)).cast("long")).select(*vox.columns, "comp")


def checkpoint_dir(spark: SparkSession) -> None:
    import tempfile

    sc = spark.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp())  # one machine: nothing is configured


def propagate(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, by rounds of minima and pointer jumps until nothing changes. Every
    round is a checkpoint in the shared folder (the session's own if one is set)."""
    checkpoint_dir(edges.sparkSession)
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    labels = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("label")).checkpoint()
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        met = labels.join(near, labels.node == near.src).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = met.join(up, met.label == up["at"], "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")).checkpoint()
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels


@operator("GRAPH-03")
def clean_labels(vox: DataFrame, least: int, ratio: float, locked: list[int] | None = None) -> DataFrame:
    """Voxels of components that are small in size and share, and not locked, take the last kept label of their line."""
    parts = components_3d(vox.withColumn("__t", F.col("tis") + 1), "__t", full=False)
    sizes = parts.groupBy("tis", "comp").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("tis")))
    gone = sizes.where((F.col("n") < least) & (F.col("n") < ratio * F.col("total")) & ~F.col("tis").isin(locked or [-1])).select("tis", "comp", F.lit(True).alias("gone"))
    marked = parts.join(gone, ["tis", "comp"], "left").withColumn("keep", F.when(F.col("gone").isNull(), F.col("tis")))
    line = Window.partitionBy("z", "y").orderBy("x")
    before, after = F.last("keep", True).over(line.rowsBetween(Window.unboundedPreceding, 0)), F.first("keep", True).over(line.rowsBetween(0, Window.unboundedFollowing))
    return marked.withColumn("tis", F.coalesce(before, after, F.lit(0))).select(*vox.columns)


@operator("GRAPH-04")
def hysteretic(vox: DataFrame, low: float, high: float, full: bool = False, three: bool = False) -> DataFrame:
    run = per_volume if three else per_slice
    return run(vox, lambda a: np.where(K.hysteresis(a, low, high, full), 255.0, 0.0), ["src"])


@operator("GRAPH-05")
def double_hysteretic(vox: DataFrame, low: float, core_low: float, core_high: float, high: float, full: bool = False) -> DataFrame:
    return per_slice(vox, lambda a: np.where(K.hysteresis(a, low, core_low, full, core_high, high), 255.0, 0.0), ["src"])


def _connected(vox: DataFrame, inside: Column, seeds: Column, three: bool) -> DataFrame:
    """``hit``: connected to a seed through what is inside."""
    marked = vox.withColumns({"__in": inside.cast("double"), "__seed": seeds.cast("double"), "hit": F.lit(0.0)})
    run = per_volume if three else per_slice
    return run(marked, lambda m, s: K.reach(m > 0, s > 0).astype(float), ["__in", "__seed"], "hit").drop("__in", "__seed")


def point(z: int, y: int, x: int) -> Column:
    return (F.col("z") == z) & (F.col("y") == y) & (F.col("x") == x)


@operator("GRAPH-06")
def threshold_growing(vox: DataFrame, z: int, y: int, x: int, low: float, high: float, three: bool = False, limits: Column | None = None, value: float = 255.0) -> DataFrame:
    """What is connected to the seed through values from low to high; limit voxels block; the seed is always in."""
    inside = F.col("src").between(low, high) & (F.lit(True) if limits is None else ~limits) | point(z, y, x)
    return _connected(vox, inside, point(z, y, x), three).withColumn("tgt", F.when(F.col("hit") > 0, value).otherwise(0.0)).drop("hit")


@operator("GRAPH-07")
def add_label_connected(vox: DataFrame, label: int, z: int, y: int, x: int, override: bool = False, locked: list[int] | None = None, three: bool = False) -> DataFrame:
    from strata.grid import at_point
    from strata.operators.predicate import writable

    same = (F.col("tgt") == at_point(vox, "tgt", z, y, x)) & writable(override, locked)
    return _connected(vox, same, point(z, y, x), three).withColumn("tis", F.when(F.col("hit") > 0, F.lit(label)).otherwise(F.col("tis"))).drop("hit")


@operator("GRAPH-08")
def subtract_label_connected(vox: DataFrame, label: int, z: int, y: int, x: int, three: bool = False) -> DataFrame:
    from strata.grid import at_point

    same = (F.col("tgt") == at_point(vox, "tgt", z, y, x)) & (F.col("tis") == label)
    return _connected(vox, same, point(z, y, x), three).withColumn("tis", F.when(F.col("hit") > 0, F.lit(0)).otherwise(F.col("tis"))).drop("hit")


@operator("GRAPH-09")
def change_mask_connected(vox: DataFrame, mask: str, z: int, y: int, x: int, add: bool = True, col: str = "tgt") -> DataFrame:
    from strata.grid import at_point

    return _connected(vox, F.col(col) == at_point(vox, col, z, y, x), point(z, y, x), False).withColumn(mask, F.when(F.col("hit") > 0, F.lit(add)).otherwise(F.col(mask))).drop("hit")


@operator("GRAPH-10")
def flood_masked(vox: DataFrame, mask: Column, col: str = "tgt") -> DataFrame:
    return per_slice(vox.withColumn("__m", mask.cast("double")), lambda a, m: K.flood_nearest(a, m > 0), [col, "__m"], col).drop("__m")


@operator("GRAPH-11")
def fill_holes(vox: DataFrame, value: float, least: int, col: str = "tgt") -> DataFrame:
    return per_slice(vox, lambda a: np.where(K.fill_holes(a == value, least), value, a), [col], col)


@operator("GRAPH-12")
def remove_islands(vox: DataFrame, value: float, least: int, col: str = "tgt") -> DataFrame:
    return per_slice(vox, lambda a: np.where((a == value) & ~K.remove_islands(a == value, least), 0, a), [col], col)


@operator("GRAPH-13")
def fill_gaps(vox: DataFrame, n: int, value: float = 255.0, col: str = "tgt") -> DataFrame:
    return per_slice(vox, lambda a: np.where(K.fill_gaps(a == value, n), value, a), [col], col)


@operator("GRAPH-14")
def fill_unassigned(vox: DataFrame, value: float, col: str = "tgt") -> DataFrame:
    return per_slice(vox, lambda a: np.where((a == 0) & ~K.exterior(a == 0), value, a), [col], col)


@operator("GRAPH-14")
def unassigned_value(vox: DataFrame, col: str = "tgt") -> DataFrame:
    """255 if values stay below 255, 0 if they start at 1, else half way between the two largest."""
    r = vox.select(F.col(col).alias("v")).distinct().withColumn("rn", F.row_number().over(Window.orderBy(F.desc("v"))))
    two = r.agg(F.max("v").alias("hi"), F.min("v").alias("lo"), F.max(F.when(F.col("rn") == 2, F.col("v"))).alias("second"))
    return two.select(F.when(F.col("hi") <= 254, 255.0).when(F.col("lo") >= 1, 0.0).otherwise((F.col("hi") + F.coalesce("second", "hi")) / 2).alias("value"))


@operator("GRAPH-15")
def add_skin(vox: DataFrame, layers: int, value: float, outside: bool = False, three: bool = False, col: str = "tgt") -> DataFrame:
    run = per_volume if three else per_slice
    return run(vox, lambda a: np.where(K.skin_outside(a == 0, layers) if outside else K.add_skin(a != 0, layers), value, a), [col], col)


@operator("GRAPH-16")
def fill_skin(vox: DataFrame, thickness: float, background: int, skin: int, three: bool = False) -> DataFrame:
    def kernel(tis: np.ndarray) -> np.ndarray:
        if three and not ((tis == background).any() and (tis == skin).any()):
            return np.zeros(tis.shape)
        return np.where(K.fill_skin(tis, thickness, background, skin), 255.0, 0.0)

    return (per_volume if three else per_slice)(vox, kernel, ["tis"])


@operator("GRAPH-17")
def watershed(vox: DataFrame, height: int = 0, full: bool = False) -> DataFrame:
    """``tgt`` is the basin after merges of less than ``height``."""

    def kernel(a: np.ndarray) -> np.ndarray:
        basins, merges = K.watershed(a, full)
        grey = np.clip(np.floor(a + 0.5), 0, 255)
        depth = {b: int(grey[basins == b].min()) for b in np.unique(basins).tolist()}
        return K.merged_basins(basins, merges, depth, height).astype(float)

    return per_slice(vox, kernel, ["src"])


@operator("GRAPH-17")
def merge_events(vox: DataFrame, full: bool = False) -> DataFrame:
    """(z, basin, into, level)"""
    from strata.grid import image

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, merges = K.watershed(image(pdf, "src"), full)
        return pd.DataFrame([(int(pdf["z"].iloc[0]), *m) for m in merges], columns=["z", "basin", "into", "level"])

    return vox.select("z", "y", "x", "src").groupBy("z").applyInPandas(run, "z int, basin int, into int, level int")


@operator("GRAPH-18", "GRAPH-19", "GRAPH-27")
def region_growing(vox: DataFrame, full: bool = False) -> DataFrame:
    """Labels grow over the source: a path costs its steepest step."""
    return per_slice(vox, lambda a, t: K.region_growing(a, t, full).astype(float), ["src", "tis"])


@operator("GRAPH-27")
def regrow(vox: DataFrame, z_from: int, z_to: int, n: int) -> DataFrame:
    """Labels of one slice, eroded n times, grow over another; gives that slice."""
    markers = vox.where(F.col("z") == z_from).select("y", "x", F.col("tis").alias("__m"))
    both = vox.where(F.col("z") == z_to).join(markers, ["y", "x"], "left").withColumn("__m", F.coalesce("__m", F.lit(0)).cast("double"))
    return per_slice(both, lambda a, m: K.region_growing(a, K.erode(m.astype(np.int64), n)), ["src", "__m"], "tis").select(*vox.columns)


@operator("GRAPH-20")
def livewire(vox: DataFrame, z: int, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """(k, y, x): the cheapest line along edges of a slice."""
    from strata.grid import image

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gx, gy = K.sobel(image(pdf, "src"))
        size = np.hypot(gx, gy)
        path = K.livewire(1 - size / max(size.max(), 1e-9), np.degrees(np.arctan2(gy, gx)) % 180, start, end)
        return pd.DataFrame([(k, *p) for k, p in enumerate(path)], columns=["k", "y", "x"])

    return vox.where(F.col("z") == z).select("z", "y", "x", "src").groupBy("z").applyInPandas(run, "k int, y int, x int")


@operator("GRAPH-21")
def fuzzy_connectedness(vox: DataFrame, y: int, x: int, mean: float, deviation: float, contrast: float) -> DataFrame:
    return per_slice(vox, lambda a: K.fuzzy(a, (y, x), mean, deviation, contrast), ["src"])


@operator("GRAPH-22")
def fast_marching(vox: DataFrame, scale: float, seeds: Column) -> DataFrame:
    """Arrival times on the speed exp(-gradient / scale)."""

    def kernel(a: np.ndarray, s: np.ndarray) -> np.ndarray:
        gx, gy = K.sobel(a)
        return K.fast_march(np.exp(-(np.abs(gx) + np.abs(gy)) / scale), s > 0)

    return per_slice(vox.withColumn("__s", seeds.cast("double")), kernel, ["src", "__s"]).drop("__s")


@operator("GRAPH-23", "GRAPH-25")
def distance(vox: DataFrame, value: float, squared: bool = False, col: str = "tgt") -> DataFrame:
    """Signed distance to the edge of a value: inside positive."""

    def kernel(a: np.ndarray) -> np.ndarray:
        on = a == value
        far = float(sum(a.shape)) ** 2
        d = np.where(on, np.minimum(K.squared_distance(~on), far), -np.minimum(K.squared_distance(on), far))
        return d if squared else np.sign(d) * np.sqrt(np.abs(d))

    return per_slice(vox, kernel, [col], "tgt")


@operator("GRAPH-24")
def step_distance(vox: DataFrame, value: float, full: bool = False) -> DataFrame:
    return per_slice(vox, lambda a: K.bfs_distance(a == value, full), ["tgt"])


@operator("GRAPH-26")
def level_set(vox: DataFrame, rounds: int, balloon: float = 1.0, smooth: float = 0.5, scale: float = 20.0, every: int = 10) -> DataFrame:
    return per_slice(vox, lambda a, t: np.where(K.level_set(a, t > 0, rounds, balloon, smooth, scale, every), 255.0, 0.0), ["src", "tgt"])


@operator("GRAPH-28")
def skeleton_graph(vox: DataFrame, col: str = "tgt") -> DataFrame:
    """(src, dst): flat indices of neighbouring voxels that are on. Pairs along an axis, then diagonals whose ends no
    shorter steps join. A task holds a slice and the next one."""
    from strata.operators.labels import undirected

    size = vox.agg((F.max("y") + 1).cast("long").alias("h"), (F.max("x") + 1).cast("long").alias("w"))
    on = vox.where(~F.col(col).eqNullSafe(0)).select("z", "y", "x")
    pairs = on.select(F.explode(F.array(F.col("z") - 1, F.col("z"))).alias("at"), "z", "y", "x").crossJoin(F.broadcast(size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, h, w = (int(pdf[c].iloc[0]) for c in ("at", "h", "w"))
        a = np.zeros((2, h, w), dtype=bool)
        a[pdf["z"] - z, pdf["y"], pdf["x"]] = True
        edges = K.skeleton_edges(a)
        return pd.DataFrame(edges[edges[:, 0] < h * w] + z * h * w, columns=["src", "dst"])

    return undirected(pairs.groupBy("at").applyInPandas(run, "src long, dst long"))


@operator("GRAPH-29")
def edge_components(edges: DataFrame) -> DataFrame:
    return propagate(edges)


@operator("GRAPH-29")
def polylines(edges: DataFrame) -> DataFrame:
    """(line, k, node): edges of each component as lines between ends and branches."""
    labelled = edges.join(propagate(edges), F.col("src") == F.col("node")).select("label", "src", "dst")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in sorted({(min(p), max(p)) for p in zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True)}):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        left = {(min(a, b), max(a, b)) for a in near for b in near[a]}
        rows, line = [], 0
        for start in sorted(near, key=lambda n: (len(near[n]) == 2, n)):
            for nxt in near[start]:
                if (min(start, nxt), max(start, nxt)) not in left:
                    continue
                path = [start, nxt]
                left.discard((min(start, nxt), max(start, nxt)))
                while len(near[path[-1]]) == 2 and (step := [n for n in near[path[-1]] if (min(n, path[-1]), max(n, path[-1])) in left]):
                    left.discard((min(step[0], path[-1]), max(step[0], path[-1])))
                    path.append(step[0])
                rows += [(int(pdf["label"].iloc[0]), line, k, n) for k, n in enumerate(path)]
                line += 1
        return pd.DataFrame(rows, columns=["label", "line", "k", "node"])

    return labelled.groupBy("label").applyInPandas(run, "label long, line int, k int, node long")


@operator("GRAPH-30")
def grid_edges(vox: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(z, y, x, dz, dy, dx, length) for every neighbour to the right along an axis."""
    out = None
    for i, axis in enumerate(("z", "y", "x")):
        w = Window.partitionBy(*[c for c in ("z", "y", "x") if c != axis]).orderBy(axis)
        e = vox.withColumn("o", F.lead(axis).over(w)).where(F.col("o") == F.col(axis) + 1).select("z", "y", "x", *[F.lit(int(i == j)).alias(d) for j, d in enumerate(("dz", "dy", "dx"))], F.lit(spacing[i]).alias("length"))
        out = e if out is None else out.unionByName(e)
    return out


@operator("GRAPH-31")
def path(vox: DataFrame, start: tuple[int, int, int], end: tuple[int, int, int], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), intensity: float = 1.0, length: float = 1.0, angle: float = 0.0) -> DataFrame:
    """(k, z, y, x): cheapest path between two voxels (z, y, x). Only their box with a margin is read."""
    margin = 5
    low = [max(0, min(a, b) - margin) for a, b in zip(start, end, strict=True)]
    box = F.lit(True)
    for c, a, b in zip(("z", "y", "x"), start, end, strict=True):
        box = box & F.col(c).between(min(a, b) - margin, max(a, b) + margin)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full(tuple(int(pdf[c].max()) - m + 1 for c, m in zip(("z", "y", "x"), low, strict=True)), np.inf)
        a[tuple(pdf[c].to_numpy() - m for c, m in zip(("z", "y", "x"), low, strict=True))] = pdf["src"]
        ends = [tuple(v - m for v, m in zip(p, low, strict=True)) for p in (start, end)]
        found = K.dijkstra(a, *ends, spacing, intensity, length, angle)
        return pd.DataFrame([(k, *(v + m for v, m in zip(p, low, strict=True))) for k, p in enumerate(found)], columns=["k", "z", "y", "x"])

    return vox.where(box).select("z", "y", "x", "src").groupBy().applyInPandas(run, "k int, z int, y int, x int")


@operator("GRAPH-32")
def vessel_tree(vox: DataFrame, root: tuple[int, int, int], ends: list[tuple[int, int, int]], **weights: float) -> DataFrame:
    """(branch, parent, k, z, y, x): paths from the root; a branch starts where it leaves those before it."""
    spark, seen, rows = vox.sparkSession, {}, []
    for b, end in enumerate(ends):
        points = [tuple(r)[1:] for r in path(vox, root, end, **weights).orderBy("k").collect()]  # one path
        split = max((i for i, p in enumerate(points) if p in seen), default=-1)
        parent = seen[points[split]] if split >= 0 else None
        for k, p in enumerate(points[max(split, 0) :]):
            seen.setdefault(p, b)
            rows.append((b, parent, k, *p))
    return spark.createDataFrame(rows, "branch int, parent int, k int, z int, y int, x int")


@operator("GRAPH-33", "UDF-05")
def graph_cut(vox: DataFrame, inside: Column, outside: Column, sigma: float, full: bool = False) -> DataFrame:
    """Minimal cut between seeds on the source's gradient, slice by slice: meant for a region of interest."""
    marked = vox.withColumns({"__i": inside.cast("double"), "__o": outside.cast("double")})
    return per_slice(marked, lambda a, i, o: np.where(K.min_cut(a, i > 0, o > 0, sigma, full), 255.0, 0.0), ["src", "__i", "__o"]).drop("__i", "__o")


@operator("GRAPH-34")
def fix_topology(vox: DataFrame, allowed: Column, inside: bool = True) -> DataFrame:
    return per_slice(vox.withColumn("__a", allowed.cast("double")), lambda t, a: np.where(K.carve(t > 0, a > 0, inside), 255.0, 0.0), ["tgt", "__a"]).drop("__a")


@operator("GRAPH-35")
def thinning(vox: DataFrame, three: bool = False) -> DataFrame:
    return (per_volume if three else per_slice)(vox, lambda a: np.where(K.thin(a > 0), 255.0, 0.0), ["tgt"])


@operator("GRAPH-36")
def grow_cut(vox: DataFrame) -> DataFrame:
    return per_slice(vox, lambda a, t: K.grow_cut(a, t).astype(float), ["src", "tis"])


@operator("GRAPH-37")
def non_maximum(vox: DataFrame) -> DataFrame:
    return per_slice(vox, K.non_maximum, ["src"])
