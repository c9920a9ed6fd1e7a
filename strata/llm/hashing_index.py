"""Approximate nearest neighbours by multi-index hashing over learned binary codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import small, stored

#: The rotations and the radius are fitted on at most this many vectors, those with the smallest hash of their id.
SAMPLE = 4096
#: Rotations; each gives one bit for every dimension.
ROTATIONS = 4
#: Bits of a substring; every substring has an index of its own.
SUBSTRING = 16
#: The radius is set so that this share of the codes lies within it, 1,000 of them at least. With a share recall does not
#: fall as the table grows (vectors without structure: 0.96 for 50,000, 0.99 for 200,000, 0.999 for a million).
SHARE = 0.02
CANDIDATES = 1000
#: Vectors of one index block; queries of one block.
BLOCK = 16_384
QUERY_BLOCK = 16_384


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) without vectors that are null, zero or hold a null or a number that isn't finite."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def learn_rotations(sample: np.ndarray, count: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """(dims, count * dims): random rotations, each improved so that signs come close to the rotated values (iterative
    quantization)."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    out = []
    for _ in range(count):
        r, _ = np.linalg.qr(rng.standard_normal((d, d)))
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ vt).T
        out.append(r)
    return np.concatenate(out, axis=1)


def codes(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """(n, words) of uint16 substrings of the signs."""
    bits = np.packbits(vectors @ rotations >= 0, axis=1)
    if bits.shape[1] % 2:
        bits = np.pad(bits, ((0, 0), (0, 1)))
    return np.ascontiguousarray(bits).view(np.uint16)


def as_matrix(lists: pa.ListArray) -> np.ndarray:
    values = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


class Index:
    """Sorted substrings of the codes of one block."""

    def __init__(self, code: np.ndarray) -> None:
        self.code = code
        self.words = np.ascontiguousarray(np.pad(code, ((0, 0), (0, -code.shape[1] % 4)))).view(np.uint64)
        self.tables = []
        for t in range(code.shape[1]):
            order = np.argsort(code[:, t], kind="stable")
            keys, starts = np.unique(code[order, t], return_index=True)
            self.tables.append((keys, np.append(starts, len(order)), order))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius. By the pigeonhole principle such a code lies within radius // substrings
        in at least one substring; those buckets are probed and the whole codes compared."""
        near, share = np.zeros(len(self.code), dtype=bool), radius // len(query)
        for t, (keys, starts, order) in enumerate(self.tables):
            hit = np.bitwise_count(keys ^ query[t]) <= share
            if hit.all():
                near[:] = True
                break
            lengths = np.diff(starts)[hit]
            at = np.repeat(starts[:-1][hit] - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else [], lengths).astype(np.int64) + np.arange(lengths.sum())
            near[order[at]] = True
        rows = np.flatnonzero(near)
        word = np.pad(query, (0, -len(query) % 4)).view(np.uint64)
        return rows[np.bitwise_count(self.words[rows] ^ word).sum(axis=1) <= radius]


def fit(vectors: DataFrame, candidates: float) -> tuple[np.ndarray, int]:
    """Rotations, and the radius within which a share ``candidates`` of other codes lies, from the bounded sample."""
    x = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    rotations = learn_rotations(x, ROTATIONS)
    c = codes(x, rotations)
    words = np.ascontiguousarray(np.pad(c, ((0, 0), (0, -c.shape[1] % 4)))).view(np.uint64)
    seen = [np.delete(np.bitwise_count(words ^ words[i]).sum(axis=1), i) for i in range(0, len(words), max(1, len(words) // 256))]
    seen = np.concatenate(seen) if len(words) > 1 else np.zeros(1)
    return rotations, int(np.ceil(np.quantile(seen, min(1.0, candidates))))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", share: float = SHARE, least: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: for every id divisible by ``every`` the ``k`` best inner products with other rows.

    Every usable vector is in an index block (dealt by a hash of its id, so equal or similar vectors spread); blocks of
    queries meet blocks of the index, and what lies within the radius is ranked by the vectors themselves. The queries that
    find fewer than ``k`` in all blocks together go through them again without a radius, so each query gets ``k`` rows, or
    all there are. Vectors of different lengths have no inner product: each length is a table of its own. Null ids and
    unusable vectors take no part. Rows of equal id are told apart only by their vectors; neither is the other's
    neighbour. Ties go to the smaller id. An empty table gives an empty result.
    """
    base = usable(vectors, id_col, vec_col).withColumn("dims", F.size("v"))
    sizes = base.groupBy("dims").agg(F.count("*").alias("n"), F.count_if(F.pmod("id", F.lit(every)) == 0).alias("asked")).collect()  # a row for each length
    out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for r in sizes:
        if r["asked"]:
            out = out.unionByName(found(base.where(F.col("dims") == r["dims"]).drop("dims"), r["n"], k, every, share, least))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def found(base: DataFrame, total: int, k: int, every: int, share: float, least: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each index block for each query, of vectors of one length."""
    rotations, radius = fit(base, max(share, least / total))
    blocks = max(1, -(-total // BLOCK))
    query_blocks = max(1, -(-total // every // QUERY_BLOCK))
    index = base.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = base.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("id"), F.col("v").alias("v")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int"))

    def search(stored: pa.Table, queries: pa.Table, whole: bool) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not stored.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids = stored["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = as_matrix(stored["v"].combine_chunks())[order]
        table = None if whole else Index(codes(x, rotations))
        q = as_matrix(queries["v"].combine_chunks())
        out: tuple[list, list, list] = [], [], []
        for qid, vector, code in zip(queries["id"].to_pylist(), q, codes(q, rotations), strict=True):
            rows = np.arange(len(ids)) if whole else table.within(code, radius)
            rows = rows[ids[rows] != qid]
            score = (x[rows] * vector).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:k]
            out[0].append(np.full(len(best), qid))
            out[1].append(ids[rows][best])
            out[2].append(score[best])
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=names)

    def met(queries: DataFrame, whole: bool) -> DataFrame:
        queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = index.groupBy("block", "part").cogroup(queries.groupBy("block", "part"))
        return stored(pairs.applyInArrow(lambda a, b: search(a, b, whole), "query_id long, vec_id long, score double"), "found")

    near = met(asked, False)
    full = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("__id"))
    full = stored(full, "full")
    short = asked.join(small(full), F.col("id") == F.col("__id"), "left_anti")
    if short.isEmpty():
        return near
    return near.join(small(full), F.col("query_id") == F.col("__id"), "left_semi").unionByName(met(short, True))
