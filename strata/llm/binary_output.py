"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on doc_id, stripes read in parallel."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.chunks import PORTION, groups, plain, portions
from strata.llm.common import shared_dir, small, stored, text_or_empty, worker_tables
from strata.llm.shingles import U, mix, run_hashes

SCHEMA = "doc_id long, part int, before long, after long, ids array<int>"
#: Row groups of this many documents carry minima, maxima and a Bloom filter, so a reader skips what it doesn't need.
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "lz4",
}

# How byte-level tokenizers cut a text, and the same for texts of the first 706 code points alone.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-\u02c1", "0-9²³¹¼-¾"
CUT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
BEYOND_LATIN = re.compile("[^\x00-\u02c1]")

BLANKS = (" ", "\n")

#: Pieces a worker remembers at most, and of how many ids in all.
REMEMBERED, REMEMBERED_IDS = 1 << 19, 1 << 22
#: Longer pieces are hashed byte by byte.
LONG = 64

_masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
_odd = [U(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if it is one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + length], one after another."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def piece_hashes(text: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every run of bytes, eight bytes at a time; of at most eight bytes the second one tells them all."""
    eight = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    size = stops - starts
    one = eight[starts] & _masks[np.minimum(size, 8)]
    two = one * _odd[0]
    at, left = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(left):
        more = eight[starts[left] + at] & _masks[np.minimum(size[left] - at, 8)]
        one[left], two[left] = mix(one[left]) + more, mix(two[left]) * _odd[1] + more
        at, left = at + 8, left[size[left] > at + 8]
    if len(long := np.flatnonzero(size > LONG)):
        one[long], two[long] = run_hashes(np.frombuffer(text, dtype=np.uint8), starts[long], stops[long])
    return mix(one + size.astype(U) * _odd[2]), two


def doubtful(texts: list[bytes]) -> set[int]:
    """Texts outside of which all are plain: those with two blanks or line feeds side by side, or with a byte that may
    begin another white space (control characters, and the first bytes of U+0085, 00A0, 1680, 2000 to 205F and 3000)."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    alone = (data == 32) | (data == 10)
    other = ((data < 32) & (data != 10)) | (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
    at = np.concatenate([np.flatnonzero(alone[1:] & alone[:-1]), np.flatnonzero(other)])
    return set(np.searchsorted(np.cumsum([len(t) for t in texts]), at, side="right").tolist())


class Encoder:
    """A byte-level tokenizer of the tokenizers library, as its file says.

    A plain text (see chunks.plain) is cut before every blank and line feed, where the tokenizer cuts it too. Pieces are
    told apart by two 64-bit hashes; only those not met before are cut into words by the tokenizer's own pattern, and
    its model encodes every new word once. A table of two places for each hash remembers a bounded number of pieces; one
    met again gives way only if it is not met once more before the next one asks for its place. Any other text is encoded
    whole, and so is one that holds the string of an added token, which the tokenizer finds before it cuts.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        added = [x["content"] for x in spec.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = model["type"] == "BPE" and "\n" not in model["vocab"] and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if self.known:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.mark = max(model["vocab"].values()) + 1
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.words = Tokenizer(models.BPE(model["vocab"] | {"\n": self.mark}, merges, cache_capacity=0))
            self.cut = regex.compile(CUT)
            self.letters = byte_letters() | {10: "\n"}
            self.feed = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, dtype="<i4")
        self.forget()

    def plain(self, text: str, looked_at: bool = False) -> bool:
        return bool(self.known and text and (looked_at or plain(text)) and not (self.added and self.added.search(text)))

    def forget(self) -> None:
        bits = max(1, REMEMBERED.bit_length() - 1)
        # A key that no hash has in its place; whether a place is free (0), taken (1) or was met again (2).
        self.shift, self.keys = U(64 - bits), ~(np.arange(1 << bits, dtype=U) << U(64 - bits))
        self.check, self.used = np.zeros(1 << bits, dtype=U), np.zeros(1 << bits, dtype=np.uint8)
        self.start, self.length = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.pool, self.filled = np.zeros(1 << 10, dtype="<i4"), 0

    def make_room(self) -> None:
        """Let go of ids that no piece has any more; forget all pieces if theirs are over half of what may be kept."""
        held = np.flatnonzero(self.used)
        length = self.length[held]
        if 2 * int(length.sum(dtype=np.int64)) > REMEMBERED_IDS:
            return self.forget()
        start, parts = self.start[held].astype(np.int64), range(0, len(held), 1 << 14)
        self.pool = np.concatenate([self.pool[:0], *(gathered(self.pool, start[a : a + (1 << 14)], length[a : a + (1 << 14)]) for a in parts)])
        self.start[held], self.filled = np.cumsum(length) - length, len(self.pool)

    def find(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of pieces, and which are there."""
        place = (one >> self.shift).view(np.int64)
        there = (self.keys[place] == one) & (self.check[place] == two)
        rest = np.flatnonzero(~there)
        place[rest] ^= 1
        there[rest] = (self.keys[place[rest]] == one[rest]) & (self.check[place[rest]] == two[rest])
        return place, there

    def fill(self, ids: np.ndarray) -> None:
        if self.filled + len(ids) > len(self.pool):
            held, self.pool = self.pool[: self.filled], np.empty(self.filled + max(self.filled, len(ids)), dtype="<i4")
            self.pool[: self.filled] = held
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def remember(self, one: np.ndarray, two: np.ndarray, length: np.ndarray) -> None:
        """Pieces that are not there, whose ids the pool will be filled with; where several ask for one place, the first gets it."""
        place = (one >> self.shift).view(np.int64)
        other = place ^ 1
        place = np.where(self.used[other] < self.used[place], other, place)
        full = self.used[place] == 2
        self.used[place[full]] = self.used[place[full] ^ 1] = 1
        place[full] = -1
        place, new = np.unique(place, return_index=True)
        place, new = (place[1:], new[1:]) if len(place) and place[0] < 0 else (place, new)
        self.keys[place], self.check[place], self.used[place] = one[new], two[new], 1
        self.start[place], self.length[place] = self.filled + (np.cumsum(length) - length)[new], length[new]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4").tobytes()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has: many in one call, each followed by a mark, which merges with nothing."""
        if not words:
            return np.zeros(0, dtype="<i4"), np.zeros(0, np.int64)
        lines = ["\n".join([*words[at : at + 100], ""]).encode().decode("latin-1").translate(self.letters) for at in range(0, len(words), 100)]
        found = (x for at in range(0, len(lines), 20) for x in self.words.encode_batch_fast(lines[at : at + 20], add_special_tokens=False))
        ids = np.concatenate([np.array(x.ids, dtype="<i4") for x in found])
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        cut = self.cut if BEYOND_LATIN.search("".join(new)) else CUT_LATIN
        # The pattern cuts before white space that stands alone, so a piece that begins with it goes on in its forerunner's call.
        alone = [p in BLANKS for p in new]
        at = [0, *(i for i in range(1, len(new)) if alone[i] or alone[i - 1] or new[i][0] not in BLANKS), len(new)]
        words = [w for a, b in pairwise(at) for w in cut.findall("".join(new[a:b]))]
        place = {w: i for i, w in enumerate(dict.fromkeys(["\n", *words]))}
        flat = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        ids, lengths = self.encode_words(list(place)[1:])
        pool, lengths = np.concatenate([self.feed, ids]), np.concatenate([[len(self.feed)], lengths])
        ends = np.concatenate([[0], np.cumsum(lengths[flat])])
        reach, size = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x))) for x in (words, new))
        bounds = np.concatenate([[0], np.searchsorted(reach, size) + 1])
        return gathered(pool, (np.cumsum(lengths) - lengths)[flat], lengths[flat]), np.diff(ends[bounds])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        if len(texts) == 1 and len(texts[0]) > PORTION and self.plain(texts[0]) and " " in texts[0][1:]:
            return [b"".join(self.encode([p])[0] for p in portions(texts[0]))]
        raw = [t.encode() for t in texts]
        odd = doubtful(raw)
        easy = [i for i, t in enumerate(texts) if self.plain(t, i not in odd)]
        out = dict(zip(easy, self.encode_plain([raw[i] for i in easy]), strict=True)) if easy else {}
        return [out[i] if i in out else self.whole(t) for i, t in enumerate(texts)]

    def encode_plain(self, texts: list[bytes]) -> list[bytes]:
        raw = b"".join(texts)
        data = np.frombuffer(raw, dtype=np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(data), dtype=bool)
        first[np.concatenate([[0], ends[:-1]])] = True
        starts = np.flatnonzero(first | (data == 32) | (data == 10))
        stops = np.append(starts[1:], len(data))
        one, two = piece_hashes(raw, starts, stops)
        if len(self.keys) > max(2, REMEMBERED):
            self.forget()
        if self.filled > REMEMBERED_IDS:
            self.make_room()
        place, there = self.find(one, two)
        start, length = self.start[place].astype(np.int64), self.length[place].astype(np.int64)
        self.used[place[there]] = 2
        if len(new := np.flatnonzero(~there)):
            keys, where, which = np.unique(one[new], return_index=True, return_inverse=True)
            where = new[where]
            if (two[where][which] != two[new]).any():
                return [self.whole(t.decode()) for t in texts]  # two pieces share a hash
            ids, lengths = self.encode_pieces([raw[a:b].decode() for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            start[new], length[new] = (self.filled + np.cumsum(lengths) - lengths)[which], lengths[which]
            self.remember(keys, two[where], lengths)
            self.fill(ids)
        ids = gathered(self.pool, start, length).tobytes()
        cuts = np.concatenate([[0], np.cumsum(length)[np.searchsorted(starts, ends, side="left") - 1]]) * 4
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def encoder(path: str) -> Encoder:
    own = worker_tables("binary_output")
    if path not in own:
        own[path] = Encoder(path)
    return own[path]


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = np.zeros(len(encoded) + 1, dtype=np.int32)
    np.cumsum([len(b) >> 2 for b in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), dtype="<i4")))


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write (doc_id, part, before, after, ids) to ``path``, documents in ascending doc_id order over all files.

    ``part`` numbers the written ranges in that order; ``before`` and ``after`` count the ids of a range ahead of a
    document and up to its end. Every document ends with ``end_id``. A null text is an empty one; null doc_ids come
    first; rows with equal doc_id follow in order of their texts. Texts are sorted before they are encoded: they are
    smaller than their ids. Texts of any length are encoded whole, other columns are not used, and an empty table gives
    an empty file.
    """

    end = np.array([end_id], dtype="<i4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in groups(texts, 1000, PORTION):
                encoded = [x + end for x in own.encode(texts[a:b])]
                ends = before + np.cumsum([len(x) >> 2 for x in encoded])
                starts = np.concatenate([[before], ends[:-1]]).astype(np.int64)
                before = int(ends[-1])
                columns = [ids.slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(ends.astype(np.int64)), id_lists(encoded)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "before", "after", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    placed = rows.repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    writer = placed.mapInArrow(encode, SCHEMA).write
    for key, value in ORC_OPTIONS.items():
        writer = writer.option(key, value)
    writer.orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The written table. A predicate on doc_id is pushed to the files' indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"],
            )

    rows = tokens.mapInArrow(sums, "doc_id long, part int, before long, n_tokens long, ids_crc32 long")
    order = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = tokens.groupBy(F.col("part").alias("__part")).agg(F.max("after").alias("__n"))  # one row for each written range
    offsets = stored(parts.select("__part", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__offset")), "offsets")
    return rows.join(small(offsets), rows["part"] == F.col("__part")).select("doc_id", (F.col("__offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    path = f"{shared_dir(docs.sparkSession)}/token_ids"
    write_token_ids(docs, path, tokenizer, end_id)
    return digest(read_token_ids(docs.sparkSession, path))
