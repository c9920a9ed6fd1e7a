"""Similarity join of word n-gram sets through parity sketches.

A sketch has one cell for each of P parts of the hash space; a set's cell is the XOR of the hashes that fall into it.
One element more or less changes one cell, so the number of cells that differ never exceeds the symmetric difference,
and it turns one bit of a sketch of parity bits, so their Hamming distance doesn't either. Sets that are similar enough differ by at most D
elements, D being known for a band of sizes; of P = D + 1 + S cells more than S are then equal, and equal cells make
candidates, which go on if their sketches are near enough. As more than S are equal, a set may leave out S cells of its band, if all sets agree on which go first: cells
without an element, then those that most sets share. Candidates are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.chunks import groups
from strata.llm.common import connected_components, free, fresh, small, stored, text_or_empty, worker_tables
from strata.llm.shingles import U, mix, shingle_sets

BAND_BITS = 8
#: Rows of one side when the members of a large bucket are compared in blocks.
BLOCK = 2048
#: Bits of a sketch for an element. With few, sets look nearer than they are, and more pairs are verified in vain.
WIDTH = 4
#: Cells that more sets share may be left out (as far as S allows); it costs a shuffle, so smaller ones are not.
CROWDED = 16


@dataclass(frozen=True)
class Similarity:
    """Two sets link when den * intersection >= num * union."""

    num: int
    den: int

    def room(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def smallest(self, n: int) -> int:
        """The smallest size that can link to one of n."""
        return -(-n * self.num // self.den)


@dataclass(frozen=True)
class Band:
    """Pairs whose smaller set has at most ``upper`` elements (and more than the band before)."""

    number: int
    upper: int
    parts: int
    spare: int


@lru_cache(maxsize=None)
def band_of(sim: Similarity, n: int) -> Band | None:
    """None for sets so small that only equal ones link."""
    upper, number = 1, 0
    while sim.room(upper, upper * sim.den // sim.num) < 1:
        upper += 1
    if n < upper:
        return None
    while upper < n:
        upper, number = max(upper + 1, upper * 5 // 4), number + 1
    room = sim.room(upper, upper * sim.den // sim.num)
    return Band(number, upper, room + 1 + room // 8, room // 8)


@lru_cache(maxsize=None)
def bands_of(sim: Similarity, n: int) -> tuple[Band, ...]:
    """The bands in which a set of n elements can be the smaller or the larger one of a pair."""
    if (last := band_of(sim, n)) is None:
        return ()
    low = sim.smallest(n)
    found = {last.number: last}
    while low < n and (b := band_of(sim, low)) is not None and b.number != last.number:
        found[b.number] = b
        low = b.upper + 1
    if low < n and band_of(sim, low) is None:  # partners too small to have a band differ by an element at least
        edge = next(m for m in range(low, n + 1) if band_of(sim, m) is not None)
        found[band_of(sim, edge).number] = band_of(sim, edge)
    return tuple(found.values())


def cells(shingles: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and XOR of the cells that hold an element."""
    part = ((shingles >> U(32)) * U(parts)) >> U(32)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[starts], np.bitwise_xor.reduceat(shingles, starts)


def parity_words(shingles: np.ndarray, band: Band) -> np.ndarray:
    """The set's sketch of its band, WIDTH bits for every element that a set of the band has at most: each element turns
    one."""
    width = -(-band.upper * WIDTH // 64)
    at = ((mix(shingles + U(band.number)) >> U(32)) * U(64 * width)) >> U(32)
    out = np.zeros(width, dtype=U)
    np.bitwise_xor.at(out, (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
    return out


def emitted(shingles: np.ndarray, sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells in all bands, and how many more of its band the set may leave out. The first S cells without an
    element are left out already: all sets agree that those go first, in the order of their numbers."""
    keys, more = [], []
    for band in bands_of(sim, len(shingles)):
        part, value = cells(shingles, band.parts)
        gaps = band.parts - len(part)
        if gaps > band.spare:
            rest = np.setdiff1d(np.arange(band.parts, dtype=U), part, assume_unique=True)[band.spare :]
            part, value = np.concatenate([part, rest]), np.concatenate([value, np.zeros(len(rest), dtype=U)])
        key = mix(value ^ mix(part + U(band.parts << 32)))
        keys.append((key & ~U((1 << BAND_BITS) - 1)) | U(band.number))
        more.append(np.full(len(key), max(0, band.spare - gaps), dtype=np.int32))
    return (np.concatenate(keys), np.concatenate(more)) if keys else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int32))


def keys_of(shingles: np.ndarray, sim: Similarity) -> np.ndarray:
    """Keys of the cells in all bands."""
    return emitted(shingles, sim)[0]


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = np.add.reduce(mix(shingles), dtype=U)
    b = np.bitwise_xor.reduce(mix(shingles + U(0x51ED270B)), initial=0) if len(shingles) else U(0)
    return int(np.int64(a.view(np.int64))), int(np.int64(U(b).view(np.int64)))


class ParityJoin:
    """The join over one table of documents; every step is a table in the shared folder, deleted when it has been used.

    What is joined are classes of equal sets, by a number ``set`` of their own. A row of the table is found again by
    doc_id and a hash of its text, so rows may repeat doc_ids.
    """

    def __init__(self, docs: DataFrame, k: int, num: int, den: int) -> None:
        self.k, self.sim = k, Similarity(num, den)
        text = text_or_empty("text")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("tid"), text.alias("text"))

    def classes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(doc, n, set) of every row; (set, doc, tid) of the row that stands for a class, that of the smallest doc; and
        (set, band, n, words), the sketches of classes. Rows without words or without a doc_id are in no class."""
        k, sim = self.k, self.sim

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_tables()
            for batch in batches:
                texts = batch.column(2).to_pylist()
                for a, b in groups(texts):
                    sets = list(shingle_sets([t.encode() for t in texts[a:b]], k))
                    bands = [bands_of(sim, len(s)) for s in sets]
                    words = [parity_words(s, x) for s, own in zip(sets, bands, strict=True) for x in own]
                    ends, inner = np.cumsum([0, *map(len, bands)]).astype(np.int32), np.cumsum([0, *map(len, words)]).astype(np.int32)
                    flat = np.concatenate(words).view(np.int64) if words else np.zeros(0, np.int64)
                    signed = [signature(s) for s in sets]
                    cols = [
                        *(pa.array([x[i] for x in signed], pa.int64()) for i in (0, 1)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array([x.number for own in bands for x in own], pa.int32())),
                        pa.ListArray.from_arrays(pa.array(ends), pa.ListArray.from_arrays(pa.array(inner), pa.array(flat))),
                    ]
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array([len(s) for s in sets], pa.int64()), *cols], ["doc", "tid", "n", "a", "b", "bands", "words"])

        sizes = stored(self.docs.mapInArrow(sign, "doc long, tid long, n long, a long, b long, bands array<int>, words array<array<long>>"), "sizes")
        known = sizes.where("n > 0 and doc is not null")
        reps = known.groupBy("n", "a", "b").agg(F.min(F.struct("doc", "tid")).alias("r")).select("n", "a", "b", "r.doc", "r.tid", F.monotonically_increasing_id().alias("set"))
        reps = stored(reps, "reps")  # so that a skewed join can be split
        rows = sizes.join(reps.select("n", "a", "b", "set"), ["n", "a", "b"], "left").select("doc", "n", F.when(F.col("doc").isNotNull(), F.col("set")).alias("set"))
        rows = stored(rows, "rows")
        own = known.join(reps.select("set", F.col("doc").alias("__doc"), F.col("tid").alias("__tid")), (F.col("doc") == F.col("__doc")) & (F.col("tid") == F.col("__tid")))
        sketches = stored(own.select("set", "n", F.explode(F.arrays_zip("bands", "words")).alias("x")).select("set", F.col("x.bands").alias("band"), "n", F.col("x.words").alias("words")), "sketches")
        free(sizes)
        return rows, reps.select("set", F.col("doc").alias("__doc"), F.col("tid").alias("__tid")), sketches

    def texts(self, reps: DataFrame) -> DataFrame:
        """(set, text) of the rows that stand for classes (more than one of a class only if rows repeat)."""
        return self.docs.join(small(reps), (F.col("doc") == F.col("__doc")) & (F.col("tid") == F.col("__tid"))).select("set", "text")

    def cells(self, texts: DataFrame, counted: bool) -> DataFrame:
        """(key, set, more) of every cell of every set; or counted, (key, hub, other, m): the smallest and largest set and
        the number of them, for the sets of a batch, so that a crowded cell is sent as few rows."""
        k, sim = self.k, self.sim

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_tables()
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
                for a, b in groups(texts):
                    found = [emitted(s, sim) for s in shingle_sets([t.encode() for t in texts[a:b]], k)]
                    keys = np.concatenate([x for x, _ in found]).view(np.int64)
                    own = np.repeat(ids[a:b], [len(x) for x, _ in found])
                    if not counted:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), pa.array(np.concatenate([m for _, m in found]))], ["key", "set", "more"])
                    elif len(keys):
                        order = np.argsort(keys, kind="stable")
                        keys, own = keys[order], own[order]
                        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                        cols = [keys[first], np.minimum.reduceat(own, first), np.maximum.reduceat(own, first), np.diff(np.append(first, len(keys)))]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "hub", "other", "m"])

        return texts.mapInArrow(emit, "key long, hub long, other long, m long" if counted else "key long, set long, more int")

    def members(self, texts: DataFrame) -> DataFrame:
        """(key, set, hub, other) of the cells that at least two sets share: two hubs of each cell and all its sets,
        except where a set leaves a crowded cell out."""
        # Most cells are alone, so a hash table of them would be large: a minimum of structs is aggregated in sorted order.
        counts = self.cells(texts, True).repartition("key").groupBy("key").agg(F.min(F.struct("hub", "other")).alias("low"), F.max("other").alias("other"), F.sum("m").alias("m"))
        shared = stored(counts.select("key", "low.hub", "other", "m").where("hub <> other"), "shared")
        met = stored(self.cells(texts, False).join(shared, "key"), "met")  # a join, so that a crowded cell can be split
        free(shared)
        order = Window.partitionBy("set", F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1))).orderBy(F.desc("m"), "key")
        crowded = met.where(f"m > {CROWDED}").withColumn("rank", F.row_number().over(order)).where("rank > more").drop("rank")
        members = stored(met.where(f"m <= {CROWDED}").unionByName(crowded).select("key", "set", "hub", "other"), "members")
        free(met)
        return members

    def sets(self, involved: DataFrame, reps: DataFrame) -> DataFrame:
        """(set, n, shingles) of some classes (more than once only if rows repeat)."""
        k = self.k

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_tables()
            for batch in batches:
                texts = batch.column(1).to_pylist()
                rows = [s.view(np.int64) for a, b in groups(texts) for s in shingle_sets([t.encode() for t in texts[a:b]], k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in rows], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["set", "n", "shingles"])

        chosen = reps.join(involved, "set", "left_semi")
        return self.texts(chosen).mapInArrow(build, "set long, n long, shingles array<long>")

    def verified(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs (a, b), stored, that link, on their whole sets."""
        involved = stored(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct(), "involved")
        sets = stored(self.sets(involved, reps), "sets")
        if sets.count() > involved.count():  # rows repeat
            sets, old = stored(sets.dropDuplicates(["set"]), "sets"), sets
            free(old)
        free(involved)
        one, two = (sets.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}")) for c in "ab")
        hubs = one.join(pairs.select("a").distinct(), "a", "left_semi")
        met = pairs.join(two, "b").join(hubs, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
        links = stored(met.where(F.col("common") * self.sim.den >= (F.col("na") + F.col("nb") - F.col("common")) * self.sim.num).select("a", "b"), "verified")
        free(sets)
        return links

    def near(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """The pairs (a, b, band, ...) whose sketches are no further apart than sets that link."""
        one, two = (sketches.select(F.col("set").alias(c), "band", F.col("n").alias(f"n{c}"), F.col("words").alias(f"w{c}")) for c in "ab")
        met = pairs.join(one, ["a", "band"]).join(two, ["b", "band"])
        apart = F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return met.where(apart <= F.expr(f"((na + nb) * {self.sim.den - self.sim.num}) div {self.sim.den + self.sim.num}")).select(*pairs.columns)

    def survivors(self, members: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b) of one bucket with different labels whose sketches are near enough. Large buckets are cut into
        blocks, and every two blocks meet in a task of their own. Unless ``every``, a row names only its nearest
        partner of each other label."""
        sim = self.sim
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        rows = (
            members.withColumn("blk", F.pmod(F.xxhash64("set"), blocks).cast("int"))
            .withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumns({"i": F.least("blk", "with"), "j": F.greatest("blk", "with")})
        )

        def compare(table: pa.Table) -> pa.Table:
            worker_tables()
            doc, label, n, blk = (table[c].to_numpy() for c in ("set", "label", "n", "blk"))
            words = table["words"].combine_chunks().flatten().to_numpy().view(U).reshape(len(doc), -1)
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            left, right = (np.flatnonzero(blk == i), np.flatnonzero(blk == j))
            a_out, b_out = [], []
            for x in left.tolist():
                other = right[(label[right] != label[x]) & (doc[right] != doc[x])]
                if i == j:
                    other = other[other > x]
                if not len(other):
                    continue
                room = (n[other] + n[x]) * (sim.den - sim.num) // (sim.den + sim.num)
                apart = np.bitwise_count(words[other] ^ words[x]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(apart <= room)
                if not every and len(near) > 1:
                    near = near[np.argsort(apart[near], kind="stable")]
                    near = near[np.unique(label[other[near]], return_index=True)[1]]
                a_out.append(np.full(len(near), doc[x]))
                b_out.append(doc[other[near]])
            a = np.concatenate(a_out) if a_out else np.zeros(0, np.int64)
            b = np.concatenate(b_out) if b_out else np.zeros(0, np.int64)
            return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

        return rows.select("key", "i", "j", "blk", "set", "label", "n", "words").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()

    def mixed(self, inner: DataFrame, edges: DataFrame) -> DataFrame:
        """(key, set, label, m) of the cells in which sets of different components are left."""
        labels = connected_components(edges, "a", "b")
        known = stored(inner.join(labels, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("label", "set").alias("label")), "known")
        free(labels)
        keys = stored(known.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "m"), "keys")
        mixed = stored(known.join(keys, "key"), "mixed")
        free(known, keys)
        return mixed

    def links(self, reps: DataFrame, sketches: DataFrame) -> DataFrame:
        """(a, b): links between classes that leave no link between two components."""
        band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int").alias("band")
        members = self.members(self.texts(reps))
        stars = members.select("set", "hub", band).unionByName(members.select("set", F.col("other").alias("hub"), band)).where("set <> hub")
        pairs = stars.groupBy(F.least("set", "hub").alias("a"), F.greatest("set", "hub").alias("b")).agg(F.count("*").alias("times"), F.min("band").alias("band"))
        pairs = stored(pairs, "pairs")
        # Sets that neither hub stands for are left to be compared with each other, in cells that have two of them.
        inner = members.where("set <> hub and set <> other").select("key", "set").distinct()
        crowd = inner.groupBy("key").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("key")
        inner = stored(inner.join(crowd, "key", "left_semi"), "inner")
        free(members)
        close = stored(self.near(pairs, sketches), "close")
        # First the hub that a set shares most cells with; then what still lies between two components.
        most = Window.partitionBy("b").orderBy(F.desc("times"), "a")
        best = stored(close.withColumn("rank", F.row_number().over(most)).where("rank = 1").select("a", "b"), "best")
        edges = self.verified(best, reps)
        labels = connected_components(edges, "a", "b")
        one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
        apart = close.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
        apart = stored(apart.join(best, ["a", "b"], "left_anti"), "apart")
        free(labels, best, close)
        more = self.verified(apart, reps)
        free(apart)
        edges, old = stored(edges.unionByName(more), "links"), (edges, more)
        free(*old)
        # The nearest partners may all have been tried: only the second, complete round tells that no link is left.
        for every in (False, True):
            mixed = self.mixed(inner, edges)
            found = self.survivors(mixed.withColumn("band", band).join(sketches, ["set", "band"]), every)
            found = stored(found.join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "survivors")
            free(mixed)
            new = self.verified(found, reps)
            edges, old = stored(edges.unionByName(new), "links"), (edges, found, new)
            free(*old)
        free(inner, pairs)
        return edges

    def components(self) -> DataFrame:
        """(doc, n, component) of every row; component is the smallest doc_id reachable by links."""
        rows, reps, sketches = self.classes()
        links = self.links(reps, sketches)
        free(sketches)
        known = rows.where("set is not null")
        # Rows of one doc_id are one document: what one of them links with, all do.
        first = known.groupBy("doc").agg(F.min("set").alias("first"), F.max("set").alias("last")).where("first <> last").select(F.col("doc").alias("__doc"), "first")
        same = known.join(first, F.col("doc") == F.col("__doc")).where("set <> first").select(F.col("set").alias("a"), F.col("first").alias("b")).distinct()
        edges = stored(links.unionByName(same), "edges")
        labels = connected_components(edges, "a", "b")
        free(links, edges)
        labelled = stored(known.join(labels, F.col("set") == F.col("node"), "left").select("doc", F.coalesce("label", "set").alias("label")), "labelled")
        free(labels)
        smallest = stored(labelled.groupBy("label").agg(F.min("doc").alias("component")), "smallest")
        found = stored(labelled.join(smallest, "label").groupBy(F.col("doc").alias("__doc")).agg(F.min("component").alias("component")), "found")
        free(labelled, smallest)
        return rows.join(found, F.col("doc") == F.col("__doc"), "left").select("doc", "n", F.coalesce("component", "doc").alias("component"))


def link_documents(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Documents without text or words have an empty set and link with nothing. Texts of fewer than k words have one
    shingle. Equal sets always link. A null doc_id stands alone with a null component; rows with equal doc_id are one
    document for links, each with the size of its own set. Texts of any length are read whole; other columns are not
    used, whatever their names. An empty table gives an empty one.
    """
    out = ParityJoin(docs, k, num, den).components()
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that have the smallest doc_id of their group of near copies, with their own columns.

    Of rows with equal doc_id one stays, with the first text in order. Null doc_ids, and texts without words, link with
    nothing and stay. An empty table stays empty.
    """
    mark = fresh(docs, "__doc")
    out = stored(link_documents(docs, k, num, den), "groups")
    dropped = out.where("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct()
    kept = docs.join(small(dropped), F.col("doc_id") == F.col(mark), "left_anti")
    again = out.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(mark))
    again = stored(again, "again")
    if again.isEmpty():
        return kept
    rest = kept.join(small(again), F.col("doc_id") == F.col(mark), "left_anti")
    several = kept.join(small(again), F.col("doc_id") == F.col(mark), "left_semi")
    first = several.groupBy(F.col("doc_id").alias(mark)).agg(F.min(text_or_empty("text")).alias(f"{mark}text"))
    one = several.join(first, (F.col("doc_id") == F.col(mark)) & (text_or_empty("text") == F.col(f"{mark}text")), "left_semi").dropDuplicates(["doc_id"])
    return rest.unionByName(one)
