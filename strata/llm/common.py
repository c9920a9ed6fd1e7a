"""Shared folders, bounded broadcasts, text columns and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side is broadcast only if it has been counted and holds no more rows than this (of at most a few longs each).
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch.
ARROW_ROWS = "1000"

_made: list[tuple[SparkSession, str]] = []

_kept: dict[str, dict] = {}


def worker_tables(operator: str | None = None) -> dict:
    """What this Python worker keeps between tasks for an operator. A worker outlives its stage, and the next stage's
    tasks go through all idle ones, so what was kept for other operators is let go, and its memory given back."""
    if others := [k for k in _kept if k != operator]:
        for k in others:
            del _kept[k]
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)
    return _kept.setdefault(operator, {}) if operator else {}


def prepare(spark: SparkSession) -> None:
    """Python workers find this package, and Arrow batches stay small, for texts may be long."""
    root = str(Path(__file__).resolve().parents[2])
    own = spark.sparkContext.environment
    if root not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [root, own.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # what was shuffled goes when its query ends


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing and all runs on one machine (tests) a temporary folder takes its place.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not base:
        base = getattr(shared_dir, "fallback", None) or tempfile.mkdtemp(prefix="strata-")
        shared_dir.fallback = base
    path = f"{base.rstrip('/')}/strata-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            return


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(f"{folder}/{name}")
    out = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
    out.stored_in = folder
    return out


def free(*tables: DataFrame) -> None:
    """Delete stored tables that nothing still to be run will read."""
    for t in tables:
        spark, folder = t.sparkSession, t.stored_in
        _delete(spark, folder)
        _made.remove((spark, folder))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The table with a broadcast hint if it is no longer than BROADCAST_ROWS, else as it is (a shuffled join follows)."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) for every node of the edges; label is the smallest node reachable.

    Minimum of the neighbours' labels, then pointer jumping, until nothing changes; every round is a written table.
    The minimum is pre-aggregated before its shuffle, so that a node with very many links does not land in one task.
    """
    both = stored(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u <> v")
        .transform(lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        .distinct(),
        "edges",
    )
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    full = labels
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        met = labels.join(near, labels.node == near.u, "left").select(
            "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = stored(
            met.join(up, met.label == up["at"], "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels"
        )
        free(full)
        full, labels = new, new.select("node", "label")
        labels.stored_in = new.stored_in
        if new.where("label < old").isEmpty():
            free(both)
            return labels


def blocks_of(total: int, rows: int = 2048, most: int = 65_536) -> int:
    """A number of blocks that grows with the table up to a bound (then blocks grow)."""
    return max(1, min(most, -(-total // rows)))


def running_sum(df: DataFrame, parts: list[str], order: list[Column], value: Column, buckets: Column, name: str) -> DataFrame:
    """Exclusive running sum of ``value`` in each ``parts`` group, ordered by ``buckets`` and then ``order``.

    A group is summed in buckets first, so one hot group spreads over as many tasks as it has buckets.
    """
    df = df.withColumn("__b", buckets).withColumn("__v", value)
    w = Window.partitionBy(*parts).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*parts, "__b").agg(F.sum("__v").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(w), F.lit(0))).drop("__s")
    keys = [*parts, "__b"]
    sums = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before")
    joined = df.join(sums, [df[k].eqNullSafe(sums[f"__k{i}"]) for i, k in enumerate(keys)]).drop(*[f"__k{i}" for i in range(len(keys))])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, (F.col("__before") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).cast("long")).drop("__b", "__v", "__before")
