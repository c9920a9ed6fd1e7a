"""Removal of long repeated strings by sorting suffixes in range-partitioned buckets.

Every string of LENGTH bytes has one anchor: of the K-byte strings in it the one with the smallest hash, the rightmost
of equals. Equal strings have their anchors at the same place, so only suffixes that begin at an anchor need sorting, and
of those only the ones whose anchor occurs twice. Suffixes that are equal as a whole are counted first, by 128-bit hashes,
and stand as one. Sampled splitters deal the others out by their leading bytes; each bucket sorts what stands right and
left of its anchors, eight bytes at a time, and neighbours in that order tell which strings around an anchor occur again.
Suffixes of one anchor have equal leading bytes and hash, so they are in one bucket and nothing is left to compare across
the boundaries of buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import free, fresh, small, stored, text_or_empty, worker_tables
from strata.llm.shingles import U, _bytes, mix, powers

LENGTH = 200
K = 48
WIDTH = LENGTH - K + 1
#: Bytes handled at once; a longer text is cut into pieces that overlap by LENGTH - 1.
PIECE = 1 << 19
INDEX_BITS = 22
LEAD = 16
#: An anchor with more different suffixes than this is split: every string around it becomes a suffix of its own.
HOT = 50_000
#: Suffixes of a bucket that are sorted together.
SORTED = 20_000


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, anchor, first string and number of strings, and hash, of every run of strings with one anchor.

    ``starts`` and ``ends`` are the texts' places in ``data``; all positions are in ``data``.
    """
    n = len(data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(_bytes[data] * up[:n], out=sums[1:], dtype=U)
    hashes = mix((sums[K:] - sums[:-K]) * down[: n - K + 1])
    low = U((1 << INDEX_BITS) - 1)
    key = (hashes & ~low) | (low - np.arange(len(hashes), dtype=U))
    whole = -(-len(key) // WIDTH) * WIDTH
    grid = np.full(whole, ~U(0), dtype=U)
    grid[: len(key)] = key
    grid = grid.reshape(-1, WIDTH)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    lengths = np.maximum(0, ends - starts - LENGTH + 1)
    text = np.repeat(np.arange(len(starts)), lengths)
    first = np.cumsum(lengths) - lengths
    q = np.repeat(starts - first, lengths) + np.arange(lengths.sum())
    at = (low - (np.minimum(behind[q], ahead[q + WIDTH - 1]) & low)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])])) if len(at) else np.zeros(0, np.int64)
    return text[new], at[new], q[new], np.diff(np.append(new, len(at))), hashes[at[new]]


def laid_out(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of bounded size: bytes, pieces' places, the texts they belong to, and where in those they begin."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[np.ndarray, ...]:
        lengths = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(p for _, _, p in parts), np.uint8), ends - lengths, ends, np.array([i for i, _, _ in parts]), np.array([o for _, o, _ in parts])

    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - LENGTH + 1), PIECE):
            piece = t[o : o + PIECE + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if parts and size + len(piece) > PIECE:
                yield out()
                parts, size = [], 0
            parts.append((i, o, piece))
            size += len(piece)
    if parts:
        yield out()


def sort_order(matrix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and bytes, and how many leading bytes each row of that order shares with the row
    before it (-1 for another group). A multikey quicksort whose characters are eight bytes: rows are split by one
    character, and only what is still equal is sorted by the next."""
    rows, width = matrix.shape
    words = np.ascontiguousarray(np.pad(matrix, ((0, 0), (0, -width % 8)))).view(">u8").astype(U)
    order = np.argsort(group, kind="stable")
    same = np.zeros(rows, dtype=bool)
    same[1:] = group[order][1:] == group[order][:-1]
    shared = np.where(same, 0, -1).astype(np.int64)
    for c in range(words.shape[1]):
        run = np.cumsum(~same)
        open_ = same.copy()
        open_[:-1] |= same[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            break
        key = words[order[at], c]
        place = np.lexsort((key, run[at]))
        order[at], key = order[at][place], key[place]
        run = run[at]
        met = np.flatnonzero(np.concatenate([[False], run[1:] == run[:-1]]))
        differ = key[met] ^ key[met - 1]
        equal = differ == 0
        rows_met = at[met]
        bits = np.frexp((differ >> U(11)).astype(np.float64))[1].astype(np.int64) + 11
        bits = np.where((differ >> U(11)) == 0, np.frexp(differ.astype(np.float64))[1], bits)
        shared[rows_met] += np.where(equal, 8, (64 - bits) // 8)
        same[rows_met] &= equal
    return order, np.minimum(shared, width)


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(suffix, offset): whether the string that begins ``offset`` bytes before the anchor occurs again in the group.

    ``left`` holds what precedes the anchors, backwards; a suffix has strings from offset ``low`` to ``high``.
    """
    n = len(group)

    def matrix(parts: list[bytes], width: int) -> np.ndarray:
        return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width)

    classes = []
    for parts, width in ((left, WIDTH - 1), (right, LENGTH)):
        order, shared = sort_order(matrix(parts, width), group)
        classes.append((order, shared))
    out = np.zeros((n, WIDTH), dtype=bool)
    ids = [np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)]
    for o in range(WIDTH):
        alive = np.flatnonzero((low <= o) & (high >= o))
        if not len(alive):
            continue
        for (order, shared), depth, own in zip(classes, (o, LENGTH - o), ids, strict=True):
            own[order] = np.cumsum(shared < depth)
        _, which = np.unique(ids[0][alive] * (n + 1) + ids[1][alive], return_inverse=True)
        out[alive, o] = np.bincount(which, weights=times[alive])[which] > 1
    return out


class Bucket:
    """Suffixes in order of their anchors, taken in one by one, each with the number of its equals; finds (row, start, end)
    of strings that occur again, but for suffixes that have equals."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int, int]] = []
        self.key: tuple | None = None
        self.seen: dict[tuple[int, bytes], int] = {}
        self.segments: list[tuple] = []  # (group, left length, bytes, strings, row, anchor)
        self.times: list[int] = []
        self.group = self.first = 0

    def span(self, row: int, at: int, low: int, high: int) -> None:
        self.found.append((row, at - high, at - low + LENGTH))

    def add(self, key: tuple, left: int, body: bytes, count: int, row: int, at: int, times: int) -> None:
        if key != self.key:
            self.close()
            self.key = key
        known = self.seen.get((left, body))
        if known is None:
            self.seen[left, body] = len(self.segments)
            self.segments.append((self.group, left, body, count, row, at))
            self.times.append(times)
            return
        if self.times[known] == 1:  # equal suffixes repeat all their strings
            self.span(self.segments[known][4], self.segments[known][5], left - count + 1, left)
        self.times[known] += times
        self.span(row, at, left - count + 1, left)

    def close(self) -> None:
        """The group is complete; one that has a single suffix has been dealt with already."""
        if len(self.segments) - self.first == 1:
            del self.segments[self.first :], self.times[self.first :]
        self.first = len(self.segments)
        self.seen.clear()
        self.group += 1
        if len(self.segments) > SORTED:
            self.sort()

    def sort(self) -> None:
        if self.segments:
            group, left, body, count, row, at = zip(*self.segments, strict=True)
            left, count = np.array(left), np.array(count)
            dup = repeated(np.array(group), [b[:n][::-1] for b, n in zip(body, left.tolist(), strict=True)], [b[n:] for b, n in zip(body, left.tolist(), strict=True)], left - count + 1, left, np.array(self.times))
            for i in np.flatnonzero((np.array(self.times) == 1) & dup.any(axis=1)).tolist():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], dup[i].view(np.int8), [0]])))
                for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
                    self.span(row[i], at[i], a, b - 1)
        self.segments, self.times, self.first = [], [], 0

    def batch(self) -> pa.RecordBatch:
        cols = np.array(self.found, dtype=np.int64).reshape(-1, 3).T
        self.found = []
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "start", "end"])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(row, start, end): byte spans of strings of LENGTH bytes that start more than once in the table (row, text), in which
    ``row`` is unique. They overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for data, starts, ends, number, offset in laid_out([t.encode() for t in batch.column(1).to_pylist()]):
                text, at, q, count, h = anchors(data, starts, ends)
                shift = offset[text] - starts[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(rows[number[text]]), pa.array(at + shift), pa.array(q + shift), pa.array(count.astype(np.int32))], ["h", "row", "at", "q", "c"]
                )

    found = stored(texts.mapInArrow(find, "h long, row long, at long, q long, c int"), "anchors")
    shared = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")  # so that a skewed join can be split
    kept = found.join(shared, "h").groupBy("row").agg(F.collect_list(F.struct("h", "at", "q", "c")).alias("anchors"))  # bounded by the text
    kept = stored(kept, "shared_anchors")
    free(found, shared)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                for m in marks:
                    h, at, q, count = m["h"], m["at"], m["q"], m["c"]
                    sig = hashlib.blake2b(data[q : q + count - 1 + LENGTH], digest_size=16, salt=(at - q).to_bytes(8, "little")).digest()
                    for column, value in zip(out, (sig, row, h, at, q, count), strict=True):
                        column.append(value)
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["sig", "row", "h", "at", "q", "c"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        for batch in batches:
            out: list[tuple] = []
            for row, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                for m in marks:
                    h, at, q, count, times = m["h"], m["at"], m["q"], m["c"], m["times"]
                    if m["n"] <= HOT:
                        out.append((data[at : at + LEAD], h, at - q, data[q : q + count - 1 + LENGTH], count, row, at, times))
                    else:
                        for s in range(q, q + count):
                            body = data[s : s + LENGTH]
                            out.append((body[:LEAD], int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True), 0, body, 1, row, s, times))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["lead", "h", "left", "body", "c", "row", "at", "times"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        bucket = Bucket()
        for batch in batches:
            for lead, h, left, body, count, row, at, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                bucket.add((lead, h), left, body, count, row, at, times)
            yield bucket.batch()
        bucket.close()
        bucket.sort()
        yield bucket.batch()

    def marked(anchors: DataFrame) -> DataFrame:
        """Texts of the rows that have anchors, with those."""
        once = involved(texts, "row", anchors.select("row"))
        return once.join(anchors.withColumnRenamed("row", "__r"), F.col("row") == F.col("__r")).select("row", "text", "anchors")

    suffixes = stored(marked(kept).mapInArrow(sign, "sig binary, row long, h long, at long, q long, c int"), "suffixes")
    free(kept)
    first = F.min(F.struct("row", "at", "q", "c", "h")).alias("first")
    equal = stored(suffixes.groupBy("sig").agg(F.count("*").alias("times"), first).select("sig", "times", "first.*"), "equal")
    end = (F.col("q") + F.col("c") - 1 + LENGTH).alias("end")
    copies = suffixes.join(equal.where("times > 1").select("sig"), "sig").select("row", F.col("q").alias("start"), end)
    copies = stored(copies, "copies")
    free(suffixes)
    several = stored(equal.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "several")
    alone = equal.join(several, "h").groupBy("row").agg(F.collect_list(F.struct("h", "at", "q", "c", "times", "n")).alias("anchors"))
    alone = stored(alone, "different")
    free(equal, several)
    bodies = stored(marked(alone).mapInArrow(cut, "lead binary, h long, left int, body binary, c int, row long, at long, times long"), "bodies")
    free(alone)
    sorted_ = stored(bodies.repartitionByRange("lead", "h").sortWithinPartitions("lead", "h").mapInArrow(sort, "row long, start long, end long"), "sorted")
    free(bodies)
    return sorted_.unionByName(copies)


def involved(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows that have (or, anti, don't have) an id in the table's column ``row``; without a shuffle of the texts while the
    ids are few."""
    mark = fresh(rows, "__id")
    return rows.join(small(ids.select(F.col("row").alias(mark))), F.col(key) == F.col(mark), how)


def merged(spans: list[dict], data: bytes) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((s["start"], s["end"]) for s in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def with_spans(docs: DataFrame, handle: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, columns: list[Column], other: list[Column]) -> DataFrame:
    """``handle`` over the rows that hold repeated strings (``columns``, then their spans), ``other`` over the rest.

    Rows are numbered and stored, so that each is found again whatever else is equal in two of them.
    """
    row = fresh(docs, "__row")
    base = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    at, spans_at = fresh(base, "__at"), fresh(base, "__spans")
    found = repeated_spans(base.select(F.col(row).alias("row"), text_or_empty("text").alias("text")))
    spans = stored(found.distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias(spans_at)), "spans")  # bounded by the text
    hit = involved(base, row, spans).join(spans.withColumnRenamed("row", at), F.col(row) == F.col(at)).select(*columns, spans_at)
    return hit.mapInArrow(handle, schema).unionByName(involved(base, row, spans, "left_anti").select(*other))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Texts are UTF-8 bytes, a null text none. Every byte in a string of LENGTH bytes that also starts anywhere else, in
    the same text or another, is removed, in all places. Empty and shorter texts keep all. Repeated rows remove each
    other's text like any other copies, and each has a row of its own; so do null doc_ids. Texts of any length are read
    whole. Other columns are not used, whatever their names. An empty table gives an empty one.
    """

    def handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                cut = merged(spans, data)
                kept, at = hashlib.sha256(), 0
                for s, e in cut:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                out.append((len(data), sum(e - s for s, e in cut), len(cut), kept.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    text = text_or_empty("text").alias("text")
    none = F.lit(0).cast("long")
    return with_spans(
        docs.select("doc_id", "text"),
        handle,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
        [F.col("doc_id").cast("long").alias("doc_id"), text],
        [
            F.col("doc_id").cast("long").alias("doc_id"),
            F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"),
            none.alias("n_removed"),
            none.alias("n_spans"),
            F.sha2(text_or_empty("text").cast("binary"), 256).alias("kept_sha256"),
        ],
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text`` (and ``n_chars`` set anew, if there is such a column).

    Only whole characters go, so what stays is text. No row is dropped, and every other column stays as it is, whatever
    its name: nulls, repeated rows and equal doc_ids too. A null text stays null.
    """
    names = docs.columns
    at = names.index("text")

    def handle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                data = (text or "").encode()
                kept, before = [], 0
                for s, e in merged(spans, data):
                    while s < e and data[s] & 0xC0 == 0x80:
                        s += 1
                    while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
                        e -= 1
                    kept.append(data[before:s])
                    before = e
                out.append((b"".join(kept) + data[before:]).decode())
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array(out, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([len(t) for t in out], pa.int64()).cast(cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    own = [F.col(f"`{c}`") for c in names]
    return with_spans(docs, handle, docs.schema, own, own)
