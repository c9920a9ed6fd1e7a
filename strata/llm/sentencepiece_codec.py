"""SentencePiece models on the tokenizers library: the model file is parsed, its normaliser, marker, scores and byte
fallback rebuilt, batches encoded with several threads. Every new piece is also encoded by the model's own library, and a
document says whether all of its pieces agreed; its ids are always the rebuilt model's."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.binary_output import id_lists
from strata.llm.chunks import PORTION, Cache, groups, plain, portions
from strata.llm.common import text_or_empty, worker_tables

MARK = "▁"
# Kinds of pieces and of models in the file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Threads that encode a batch.
THREADS = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    unknown_surface: str = " \u2047 "


def parse(path: str) -> Spec:
    """What the file says; a ValueError for what the rebuilt model does not do."""
    spec = Spec()
    with open(path, "rb") as file:
        data = file.read()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            spec.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            spec.model, spec.byte_fallback, spec.unknown = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0)
            spec.unknown_surface = trainer.get(44, spec.unknown_surface.encode()).decode()
            if trainer.get(24, 0):
                raise ValueError(f"{path}: white space as a suffix is not supported")
        elif number == 3:
            norm = dict(fields(value))
            spec.charsmap, spec.dummy_prefix, spec.squeeze = norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1))
            if not norm.get(5, 1):
                raise ValueError(f"{path}: unescaped white space is not supported")
    if spec.model not in (UNIGRAM, BPE):
        raise ValueError(f"{path}: models of kind {spec.model} are not supported")
    if any(kind == USER for _, _, kind in spec.pieces):
        raise ValueError(f"{path}: user defined symbols are not supported")
    return spec


def rebuilt(spec: Spec):
    """(tokenizer of whole texts, tokenizer of what is normalised already, two that decode: ids with and without bytes)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    unknown = spec.pieces[spec.unknown][0]
    if spec.model == BPE:
        usable = {p: s for p, s, kind in spec.pieces if kind == NORMAL}
        merges = []
        for p, s in usable.items():
            merges += sorted((-s, vocab[p[:i]], vocab[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable)
        merges.sort(key=lambda m: m[:3])
        model = models.BPE(vocab, [m[3:] for m in merges], unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0)
    else:
        # Pieces that no text may give get a name that no text has: the numbers of pieces must stay.
        named = [(p if kind in (NORMAL, BYTE, UNKNOWN) else f"\0{p}\0", s) for p, s, kind in spec.pieces]
        model = models.Unigram(named, unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    surfaces = {spec.unknown_surface if i == spec.unknown else p.replace(MARK, " "): i for i, (p, _, _) in enumerate(spec.pieces)}
    if len(surfaces) < len(spec.pieces):
        raise ValueError("two pieces have the same surface")
    whole, inner, back, plain_back = Tokenizer(model), Tokenizer(model), *[Tokenizer(models.WordLevel(surfaces, unk_token=spec.unknown_surface)) for _ in range(2)]
    whole.normalizer = normalizers.Sequence(steps)
    end = [decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])]
    whole.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), *end])
    back.decoder, plain_back.decoder = decoders.Sequence([decoders.ByteFallback(), *end]), decoders.Sequence(end)
    return whole, inner, back, plain_back


class Codec:
    def __init__(self, path: str, threads: int = THREADS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.spec = parse(path)
        self.tokenizer, self.inner, self.back, self.plain_back = rebuilt(self.spec)
        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [p for p, _, kind in self.spec.pieces if kind == NORMAL]
        #: Texts may be cut before blanks and around line feeds if no piece reaches over such a place.
        self.cuts = self.spec.model == BPE and self.spec.dummy_prefix and not self.spec.squeeze and not self.spec.charsmap and not any(MARK in p.lstrip(MARK) or "\n" in p for p in texts)
        kinds = np.array([kind for _, _, kind in self.spec.pieces])
        self.control, self.byte = kinds == CONTROL, kinds == BYTE
        from tokenizers import pre_tokenizers

        self.inner.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[1:]
        self.marker = dict((p, i) for i, (p, _, _) in enumerate(self.spec.pieces)).get(MARK)
        self.parts = Cache(self.encode_parts)
        #: Pieces on which the two libraries differ, and how many pieces and whole texts that were.
        self.bad: set[str] = set()
        self.differ = 0

    def checked(self, ours: list[list[int]], theirs: list[list[int]]) -> tuple[list[bytes], list[bool]]:
        """Our ids, and whether they are the model's own result; how often they aren't is counted."""
        same = [a == b for a, b in zip(ours, theirs, strict=True)]
        self.differ += same.count(False)
        return [np.array(a, dtype="<i4").tobytes() for a in ours], same

    def encode_whole(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        ours = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self.checked(ours, self.own.encode(texts, num_threads=1))

    def encode_parts(self, new: list[str]) -> list[bytes]:
        """``x`` is marker + x; what begins with a line feed has no marker. A hundred pieces go in one text, one to a
        line, many such texts in one batch."""
        lines = [p[1:] if p[:1] == "\n" else MARK + p for p in new]
        full = [i for i, x in enumerate(lines) if x]
        ours: list[list[int]] = [[] for _ in new]
        parts = [full[at : at + 100] for at in range(0, len(full), 100)]
        for part, found in zip(parts, self.inner.encode_batch(["\n".join(lines[i] for i in part) for part in parts], add_special_tokens=False), strict=True):
            ids, ends = found.ids, (np.flatnonzero(np.diff(found.word_ids, append=-1)) + 1).tolist()
            for i, a, b in zip(part, [0, *ends[:-1]], ends, strict=True):
                ours[i] = ids[a:b]
        ours = [self.feed + x if p[:1] == "\n" else x for p, x in zip(new, ours, strict=True)]
        theirs = self.own.encode(new, num_threads=1)
        theirs = [(b[1:] if p[:1] == "\n" else b) if p else self.own.piece_to_id([MARK]) for p, b in zip(new, theirs, strict=True)]
        ours = [x if p else [self.marker] for p, x in zip(new, ours, strict=True)]
        ids, same = self.checked(ours, theirs)
        self.bad.update(p for p, x in zip(new, same, strict=True) if not x)
        return ids

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Little-endian 32-bit ids of every text, and whether the model's own library gives the same. A portion's blank is
        the marker that a text of its own would get."""
        if len(texts) == 1 and len(texts[0]) > PORTION and self.cuttable(texts[0]):
            each = [self._encode([p[1:] if i else p]) for i, p in enumerate(portions(texts[0]))]
            return [b"".join(ids[0] for ids, _ in each)], [all(same[0] for _, same in each)]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        cut = [t.replace("\n", " \n").split(" ") if self.cuttable(t) else None for t in texts]
        ready = self.parts.ready(set().union(*[c for c in cut if c]))
        whole = zip(*self.encode_whole([t for t, c in zip(texts, cut, strict=True) if c is None]), strict=True)
        out = [(b"".join(map(ready.__getitem__, c)), not self.bad or self.bad.isdisjoint(c)) if c else next(whole) for c in cut]
        return [ids for ids, _ in out], [same for _, same in out]

    def cuttable(self, text: str) -> bool:
        return bool(text) and self.cuts and text[0] != " " and MARK not in text and "\0" not in text and plain(text)

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """Texts of ids, by the rebuilt decoder; control pieces have no text."""
        out: list[str] = [""] * len(lists)
        lists = [x[~gone] if (gone := self.control[x]).any() else x for x in lists]
        bytes_in = [bool(self.byte[x].any()) for x in lists]
        for own, which in ((self.back, True), (self.plain_back, False)):
            at = [i for i, b in enumerate(bytes_in) if b == which]
            for i, text in zip(at, own.decode_batch([lists[i].tolist() for i in at], skip_special_tokens=False), strict=True):
                out[i] = text
        return out


def codec(path: str) -> Codec:
    own = worker_tables("sentencepiece_codec")
    if path not in own:
        own[path] = Codec(path)
    return own[path]


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``n_tokens``, ``round_trip`` (whether decoding gives the text again) and ``parity``
    (whether the model's own library gives the same ids).

    A null text is an empty one, with no ids. Texts of any length are encoded whole; repeated rows alike. Columns of these
    four names are replaced, any others stay. An empty table gives an empty one.
    """
    new = ("token_ids", "n_tokens", "round_trip", "parity")
    held = [c for c in docs.columns if c not in new]
    at = held.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in groups(texts):
                encoded, parity = own.encode(texts[a:b])
                same = [x == t for x, t in zip(own.decode([np.frombuffer(x, "<i4") for x in encoded]), texts[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns), id_lists(encoded), pa.array([len(x) >> 2 for x in encoded], pa.int64()), pa.array(same), pa.array(parity)], names=[*held, *new]
                )

    own = [F.col(f"`{c}`") for c in held]
    schema = docs.select(*own, F.array().cast("array<int>").alias(new[0]), F.lit(0).cast("long").alias(new[1]), F.lit(True).alias(new[2]), F.lit(True).alias(new[3])).schema
    return docs.select(*own).mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, ids_col: str = "token_ids") -> DataFrame:
    """``tokens`` with ``text``, decoded from the ids; null ids give a null text. A column ``text`` is replaced."""
    held = [c for c in tokens.columns if c != "text"]
    at = held.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            ids = batch.column(at).to_pylist()
            texts = iter(own.decode([np.array(x, dtype=np.int64) for x in ids if x is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(texts) for x in ids], pa.string())], names=[*held, "text"])

    return tokens.select(*held).mapInArrow(run, tokens.select(*held).withColumn("text", F.lit("").cast("string")).schema)


def digest(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32, round_trip, parity for every row.

    Checksums are of the ids as little-endian 32-bit integers and of the text decoded from them. A null or empty text has
    no tokens, checksums 0 and a round trip. Null doc_ids stay; repeated rows have a row each; an empty table gives none.
    """
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip", "parity"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                encoded, parity = own.encode(texts[a:b])
                decoded = own.decode([np.frombuffer(x, "<i4") for x in encoded])
                cols = [
                    pa.array([len(x) >> 2 for x in encoded], pa.int64()),
                    pa.array([zlib.crc32(x) for x in encoded], pa.int64()),
                    pa.array([zlib.crc32(x.encode()) for x in decoded], pa.int64()),
                    pa.array([x == t for x, t in zip(decoded, texts[a:b], strict=True)], pa.bool_()),
                    pa.array(parity, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(sums, "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean, parity boolean")
