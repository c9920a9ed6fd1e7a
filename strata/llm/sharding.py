"""Uniform shuffle into shards of exact size through a hypergeometric communication matrix (DataFrame functions only).

Every source partition knows how many rows it holds; the matrix says how many of them go to each shard. Its entries are
drawn from the multivariate hypergeometric law with the given row and column sums, which is the law that a uniform
random permutation of all rows would give. Each partition permutes its rows and deals them by its line of the matrix;
each shard permutes what it got.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import stored, text_or_empty

#: Most source partitions: the matrix has at most MOST_PARTS lines of one number per shard.
MOST_PARTS = 4096
ROWS_PER_PART = 16_384


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` of ``good + bad``: inversion outwards from the mode, so it takes about a
    standard deviation of steps and has no limit on the sizes."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0:
        if up >= hi and down <= lo:
            return mode  # what rounding has left over
        if up < hi:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row sums ``rows``, column sums ``shards``; line by line, each line shard by shard from what is left."""
    rng, left, out = random.Random(seed), list(shards), []
    for count in rows:
        line, rest, draws = [], sum(left), count
        for s, room in enumerate(left):
            rest -= room
            take = hypergeometric(rng, room, rest, draws) if s + 1 < len(left) else draws
            line.append(take)
            draws -= take
        left = [a - b for a, b in zip(left, line, strict=True)]
        out.append(line)
    return out


def shard_rows(df: DataFrame, keys: list[str], shards: int = 24, seed: int = 20_24) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard, in random order).

    Shards hold equal numbers of rows, the first ones one more where it does not divide. ``keys`` tell rows apart and
    seed the permutations; rows that agree in all keys are interchangeable. An empty table stays empty. ``df`` should be
    narrow and stored, for it is read three times.
    """
    spark = df.sparkSession

    def dice(salt: int) -> Column:
        return F.xxhash64(*keys, F.lit(seed + salt))

    fine = df.withColumn("__fine", F.pmod(dice(1), F.lit(MOST_PARTS)).cast("int"))
    held = {r["__fine"]: r["n"] for r in fine.groupBy("__fine").agg(F.count("*").alias("n")).collect()}  # at most MOST_PARTS rows
    total = sum(held.values())
    parts = 1
    while parts < MOST_PARTS and (total > parts * ROWS_PER_PART or parts < 64):
        parts *= 2
    rows = [0] * parts
    for k, n in held.items():
        rows[k % parts] += n
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    lines = []
    for part, line in enumerate(communication_matrix(rows, sizes, seed)):
        ends, at = [], 0
        for n in line:
            at += n
            ends.append(at)
        lines.append((part, ends))
    matrix = spark.createDataFrame(lines, "__part int, __ends array<bigint>")  # at most MOST_PARTS rows

    deal = Window.partitionBy("__part").orderBy(dice(2), *keys)
    dealt = (
        fine.withColumn("__part", F.pmod("__fine", F.lit(parts)))
        .withColumn("__rn", F.row_number().over(deal))
        .join(F.broadcast(matrix), "__part")
        .withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rn"))))
        .drop("__fine", "__part", "__rn", "__ends")
    )
    piece = F.pmod(dice(3), F.lit(parts)).cast("int")
    dealt = stored(dealt.withColumn("__piece", piece), "dealt")
    before = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "__piece").agg(F.count("*").alias("n")).select("shard", "__piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__piece").orderBy(dice(4), *keys)
    if parts * shards <= 200_000:
        starts = F.broadcast(starts)
    return (
        dealt.withColumn("__rn", F.row_number().over(inside))
        .join(starts, ["shard", "__piece"])
        .withColumn("slot", (F.col("__start") + F.col("__rn") - 1).cast("long"))
        .drop("__rn", "__piece", "__start")
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20_24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law ``rows``.

    Equal texts are a group only in that they share text_crc32: under this law counts must be equal, so a group larger
    than a shard is spread like any other rows. A null text has no bytes: size 8 and the checksum of nothing, 0. A null
    doc_id is a value like any other; fully repeated rows are kept and each gets a slot of its own.
    """
    text = text_or_empty("text")
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(stored(narrow, "sizes"), ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
