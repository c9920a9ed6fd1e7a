"""Label algebra: lookups, compaction, hierarchies, marks, ordering and sets, as joins with small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.registry import operator

#: Labels fit in 16 bits, so a lookup table with one row a label has at most so many rows and may be broadcast.
LABELS = 65_536


def one_each(pairs: DataFrame, old: str, new: str, order: str | None = None) -> DataFrame:
    """One row a label: the last by ``order``, else the largest."""
    kept = F.max_by(new, order) if order else F.max(new)
    return pairs.where((F.col(old) >= 0) & (F.col(old) < LABELS)).groupBy(F.col(old).alias("__old")).agg(kept.alias("__new"))


@operator("JOIN-01", "JOIN-02")
def map_labels(vox: DataFrame, pairs: DataFrame, old: str = "old", new: str = "new", order: str | None = None) -> DataFrame:
    """Labels by a table of old and new ids; a label without a row stays, of repeated olds the last holds."""
    out = vox.join(F.broadcast(one_each(pairs, old, new, order)), F.col("tis") == F.col("__old"), "left")
    return out.withColumn("tis", F.coalesce("__new", "tis").cast("int")).drop("__old", "__new")


@operator("JOIN-03")
def remove_label(vox: DataFrame, label: int) -> DataFrame:
    """The label becomes background and larger ones move down by one."""
    t = F.col("tis")
    return vox.withColumn("tis", F.when(t == label, F.lit(0)).when(t > label, t - 1).otherwise(t))


@operator("JOIN-04")
def compact(tissues: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """(old, new): what stays of a tissue table gets the ids from 1 in order; removed ids map to 0."""
    gone = removed.select(F.col(key).alias("__gone")).distinct()
    marked = tissues.where(F.col(key) > 0).join(F.broadcast(gone.limit(LABELS)), F.col(key) == F.col("__gone"), "left")
    stays = F.col("__gone").isNull().cast("int")
    return marked.select(F.col(key).alias("old"), (stays * F.sum(stays).over(Window.orderBy(key))).cast("int").alias("new"))


@operator("JOIN-04")
def remove_labels(vox: DataFrame, tissues: DataFrame, removed: DataFrame) -> DataFrame:
    return map_labels(vox, compact(tissues, removed))


@operator("JOIN-05")
def remove_all(vox: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cleared grid and a tissue table with one entry."""
    table = vox.sparkSession.createDataFrame([(1, "Tissue1", 1.0, 0.0, 0.0, 0.5, False)], "id int, name string, r double, g double, b double, opac double, locked boolean")
    return vox.withColumn("tis", F.lit(0)), table


@operator("JOIN-06")
def with_missing(tissues: DataFrame, largest: int) -> DataFrame:
    """(id, name, r, g, b): ids up to ``largest`` that have no row get one, with a colour by their number."""
    ids = tissues.sparkSession.range(1, largest + 1).select(F.col("id").cast("int"))
    new = ids.join(tissues.select("id"), "id", "left_anti")

    # Steps of a colour cube of seven levels a side.
    i, step = F.col("id") - 1, 0.166666666
    colour = {"r": (i % 7) * step, "g": (F.floor(i / 7) % 7) * step, "b": F.floor(i / 49) * 0.19}
    added = new.select("id", F.concat(F.lit("Tissue"), F.col("id").cast("string")).alias("name"), *[v.cast("double").alias(k) for k, v in colour.items()])
    return tissues.select("id", "name", "r", "g", "b").unionByName(added)


@operator("JOIN-07")
def unused(tissues: DataFrame, vox: DataFrame, key: str = "id") -> DataFrame:
    used = vox.select(F.col("tis").alias("__used")).distinct()
    return tissues.join(used, F.col(key) == F.col("__used"), "left_anti")


@operator("JOIN-08")
def ids_by_name(names: DataFrame, tissues: DataFrame) -> DataFrame:
    """``names`` with ``id`` by the name in any case; 0 for a name that isn't there."""
    t = tissues.groupBy(F.lower("name").alias("__name")).agg(F.min("id").alias("id"))
    return names.join(t, F.lower("name") == F.col("__name"), "left").withColumn("id", F.coalesce("id", F.lit(0))).drop("__name")


@operator("JOIN-08")
def locks(ids: DataFrame, tissues: DataFrame) -> DataFrame:
    t = tissues.select(F.col("id").alias("__id"), "locked")
    return ids.join(t, F.col("id") == F.col("__id"), "left").withColumn("locked", F.coalesce("locked", F.lit(False))).drop("__id")


@operator("JOIN-09", "SCAN-23")
def descendants(tree: DataFrame, root: str | None = None) -> DataFrame:
    """(ancestor, id, depth) for every pair in a tree (id, parent); the recursion is as deep as the tree."""
    spark = tree.sparkSession
    tree.select("id", "parent").createOrReplaceTempView("__tree")
    start = f"WHERE id = '{root}'" if root else ""
    return spark.sql(
        f"""WITH RECURSIVE d(ancestor, id, depth) AS (
            SELECT id, id, 0 FROM __tree {start}
            UNION ALL
            SELECT d.ancestor, t.id, d.depth + 1 FROM d JOIN __tree t ON t.parent = d.id)
        SELECT ancestor, id, depth FROM d"""
    )


@operator("JOIN-09")
def rolled_up(tree: DataFrame, leaves: DataFrame, value: str) -> DataFrame:
    """(ancestor, total, n): sums of the leaves (id, value) below every node."""
    return descendants(tree).join(leaves.select("id", value), "id").groupBy("ancestor").agg(F.sum(value).alias("total"), F.count("*").alias("n"))


@operator("JOIN-10")
def all_marks(marks: DataFrame, named: bool = False) -> DataFrame:
    rows = marks.where(F.col("name").isNotNull() & (F.col("name") != "")) if named else marks
    return rows.select("z", "x", "y", "mark", "name")


@operator("JOIN-11", "JOIN-12")
def remove_mark(marks: DataFrame, z: int, x: int, y: int, radius: float) -> DataFrame:
    """Without the first mark (by ``seq``) of the slice within the radius."""
    near = (F.col("z") == z) & ((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= radius * radius)
    first = marks.where(near).agg(F.min("seq").alias("__first"))
    return marks.join(F.broadcast(first), F.col("seq") == F.col("__first"), "left_anti")


@operator("JOIN-11", "JOIN-12")
def add_marks(marks: DataFrame, new: DataFrame) -> DataFrame:
    return marks.unionByName(new)


@operator("JOIN-13")
def match_objects(objects: DataFrame, cell: float, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(z, id, next_id, score): for each object (z, id, cx, cy, size) of a slice the best of the next slice within
    ``cell``, ties by id. Centres are dealt into square cells of that width, so an object meets only neighbours. Objects
    of one place and size have one answer, and only the smallest id of them can be one, so they meet as one."""
    kinds = objects.groupBy("z", "cx", "cy", "size").agg(F.min("id").alias("next_id"))
    gx, gy = F.floor(F.col("cx") / cell).alias("gx"), F.floor(F.col("cy") / cell).alias("gy")
    places = kinds.groupBy("z", "cx", "cy").agg(F.collect_list(F.struct("size", "next_id")).alias("kinds"))
    near = F.explode(F.expr("transform(sequence(0, 8), i -> named_struct('dx', i % 3 - 1, 'dy', floor(i / 3) - 1))"))
    asked = places.withColumn("d", near).select("z", "cx", "cy", F.col("kinds").alias("asked"), (gx + F.col("d.dx")).alias("gx"), (gy + F.col("d.dy")).alias("gy"))
    nxt = places.select((F.col("z") - 1).alias("z"), F.col("cx").alias("nx"), F.col("cy").alias("ny"), "kinds", gx, gy)
    apart = F.sqrt(F.pow(F.col("cx") - F.col("nx"), 2) + F.pow(F.col("cy") - F.col("ny"), 2))
    met = asked.hint("merge").join(nxt, ["z", "gx", "gy"]).withColumn("apart", apart).where(F.col("apart") <= cell)
    each = met.select("z", "cx", "cy", F.explode(F.col("asked")["size"]).alias("size"), "apart", "kinds")

    def scored(k: Column) -> Column:
        score = F.col("apart") * weights[0] + F.abs(F.col("size") - k["size"]) * weights[1]
        return F.struct(score.isNull().alias("none"), score.alias("score"), k["next_id"].alias("next_id"))

    best = each.select("z", "cx", "cy", "size", F.array_min(F.transform("kinds", scored)).alias("b")).groupBy("z", "cx", "cy", "size").agg(F.min("b").alias("b"))
    k, o = best.alias("k"), objects.alias("o")
    same = (F.col("o.z") == F.col("k.z")) & (F.col("o.cx") == F.col("k.cx")) & (F.col("o.cy") == F.col("k.cy")) & F.col("o.size").eqNullSafe(F.col("k.size"))
    return o.join(k.hint("merge"), same).groupBy("o.z", "o.id").agg(F.min("b").alias("b")).select("z", "id", "b.next_id", "b.score")


def nearest_of(asked: DataFrame, given: DataFrame, cell: float) -> DataFrame:
    """(id, x, y, to): for each point (id, x, y) the id of the nearest of ``given``, ties by id. Points are dealt into
    square cells and meet their own and the eight around; a nearest one within a cell's width is final, and the
    others meet cells of twice the width, until none are left."""
    near = F.explode(F.expr("transform(sequence(0, 8), i -> named_struct('dx', i % 3 - 1, 'dy', CAST(floor(i / 3) AS INT) - 1))"))
    found, left = None, asked
    while True:
        gx, gy = F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)
        cells = given.select(gx.alias("gx"), gy.alias("gy"), F.col("id").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        spread = left.withColumn("o", near).select("id", "x", "y", (gx + F.col("o.dx")).alias("gx"), (gy + F.col("o.dy")).alias("gy"))
        d = F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)
        met = spread.join(cells, ["gx", "gy"]).groupBy("id", "x", "y").agg(F.min(F.struct(d.alias("d"), F.col("to"))).alias("m"))
        # Short of the width by a little, for the cells' edges are rounded.
        done = met.where(F.sqrt("m.d") <= 0.999 * cell).select("id", "x", "y", F.col("m.to").alias("to")).checkpoint()
        found = done if found is None else found.unionByName(done)
        left = left.join(done.select("id"), "id", "left_anti").checkpoint()
        if left.isEmpty():
            return found
        cell *= 2


@operator("JOIN-14")
def mutual_nearest(one: DataFrame, two: DataFrame) -> DataFrame:
    """(a, b) of components (id, cx, cy) of two slices that are each other's nearest, ties by id. Of components at one
    place only the smallest id can be a nearest one."""
    from strata.operators.region import checkpoint_dir

    checkpoint_dir(one.sparkSession)

    def places(rows: DataFrame) -> DataFrame:
        x, y = F.col("cx").cast("double"), F.col("cy").cast("double")
        return rows.where(F.abs(x + y) < float("inf")).groupBy(x.alias("x"), y.alias("y")).agg(F.min("id").alias("id")).checkpoint()

    a, b = places(one), places(two)
    size = [d.agg(F.count("*"), *[f(c) for c in "xy" for f in (F.min, F.max)]).first() for d in (a, b)]
    if not (size[0][0] and size[1][0]):
        return a.select(F.col("id").alias("a")).join(b.select(F.col("id").alias("b")), F.lit(False))
    spans = [max(s[i + 1] for s in size) - min(s[i] for s in size) for i in (1, 3)]
    n = min(size[0][0], size[1][0])
    cell = max((spans[0] * spans[1] / n) ** 0.5, max(spans) / n) or 1.0
    ab = nearest_of(a, b, cell).select(F.col("id").alias("a"), F.col("to").alias("b"))
    return ab.join(nearest_of(b, a, cell).select(F.col("to").alias("a"), F.col("id").alias("b")), ["a", "b"])


@operator("JOIN-15")
def touching(vox: DataFrame) -> DataFrame:
    """(a, b, n): pairs of different labels on neighbouring voxels along an axis, and how often."""
    out = None
    for axis in ("x", "y", "z"):
        rest = [c for c in ("z", "y", "x") if c != axis]
        w = Window.partitionBy(*rest).orderBy(axis)
        met = vox.where("tis > 0").withColumns({"o": F.lead("tis").over(w), "at": F.lead(axis).over(w)}).where((F.col("at") == F.col(axis) + 1) & (F.col("o") != F.col("tis")))
        pairs = met.select(F.least("tis", "o").alias("a"), F.greatest("tis", "o").alias("b"))
        out = pairs if out is None else out.unionByName(pairs)
    return out.groupBy("a", "b").agg(F.count("*").alias("n"))


#: Words that make a tissue a bone, and those folded onto the cortical part.
BONE_WORDS = ["cortical", "cancellous", "marrow", "tooth", "bone"]


def is_bone(name: Column) -> Column:
    out = F.lit(False)
    for w in BONE_WORDS:
        out = out | F.contains(F.lower(name), F.lit(w))
    return out


@operator("JOIN-15")
def bone_connections(vox: DataFrame, tissues: DataFrame) -> DataFrame:
    """Touching bones; cancellous and marrow parts count as the cortical part of the same name."""
    bones = tissues.where(is_bone(F.col("name"))).withColumn("twin", F.regexp_replace(F.lower("name"), "cancellous|marrow", "cortical"))
    cortical = tissues.groupBy(F.lower("name").alias("twin")).agg(F.min("id").alias("twin_id"))
    folded = bones.join(cortical, "twin", "left").select(F.col("id").alias("old"), F.coalesce("twin_id", "id").alias("new"))
    only = vox.join(F.broadcast(folded.select(F.col("old").alias("__old"), F.col("new").alias("__new")).limit(LABELS)), F.col("tis") == F.col("__old")).withColumn("tis", F.col("__new").cast("int"))
    return touching(only.drop("__old", "__new"))


@operator("JOIN-16")
def layer_of(vox: DataFrame, layers: DataFrame, name: str) -> DataFrame:
    return vox.join(F.broadcast(layers.where(F.col("name") == name).select("layer").limit(1)), "layer", "left_semi")


@operator("SORT-01")
def bucket_order(vox: DataFrame, w: int, h: int) -> DataFrame:
    """Voxels of a slice in order of their rounded grey value, then of their index."""
    from strata.operators.point import grey

    return vox.withColumns({"grey": grey(F.col("src")), "idx": F.col("x") + F.col("y") * w}).withColumn("rank", F.row_number().over(Window.partitionBy("z").orderBy("grey", "idx")))


@operator("SORT-02", "SORT-03")
def smallest(rows: DataFrame, priority: str, key: str, k: int = 1) -> DataFrame:
    """What a priority queue gives first: the k smallest priorities, ties by key."""
    return rows.orderBy(priority, key).limit(k)


@operator("SORT-04")
def split_label(sizes: DataFrame, label: int, first_new: int, most: int = 10) -> DataFrame:
    """(comp, new): the largest component keeps the label, the next ones get new labels, the rest share the last."""
    rn = F.row_number().over(Window.orderBy(F.desc("n"), F.desc("comp")))
    return sizes.withColumn("rn", rn).select("comp", "n", F.when(F.col("rn") == 1, F.lit(label)).otherwise(F.lit(first_new) + F.least(F.col("rn") - 2, F.lit(most - 1))).cast("int").alias("new"))


@operator("SORT-05")
def ordered(tissues: DataFrame, by: str = "name") -> DataFrame:
    return tissues.orderBy(by, "id")


@operator("SORT-06")
def large_components(sizes: DataFrame, least: int) -> DataFrame:
    """(comp, n, new): components of at least so many voxels, numbered from 1 by falling size."""
    return sizes.where(F.col("n") >= least).withColumn("new", F.row_number().over(Window.orderBy(F.desc("n"), "comp")))


@operator("SET-01")
def combined_selection(a: DataFrame, b: DataFrame) -> DataFrame:
    flags = [c for c, t in a.dtypes if t == "boolean"]
    keys = [c for c in a.columns if c not in flags]
    return a.unionByName(b).groupBy(*keys).agg(*[F.bool_or(c).alias(c) for c in flags])


@operator("SET-02")
def selection(ids: DataFrame, key: str = "id") -> DataFrame:
    return ids.select(key).distinct().orderBy(key)


@operator("SET-03")
def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


@operator("SET-04")
def union_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


@operator("SET-05")
def add_tissue(tissues: DataFrame, new: DataFrame) -> DataFrame:
    return tissues.unionByName(new)


@operator("SET-05")
def drop_tissue(tissues: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return tissues.join(gone.select(key), key, "left_anti")


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
