"""Stupid-backoff language-model scores, as a join of hash-partitioned n-gram counts to documents' n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.chunks import groups
from strata.llm.common import stored, text_or_empty
from strata.llm.shingles import U, hashed_words, mix

#: Executors are sent the ranks and counts of so many of the most frequent words, which stand for their hashes in what is
#: shuffled. All other words keep their 64-bit hashes, and their counts are joined.
KNOWN = 65_535
LIMIT = np.uint64(KNOWN + 1)
#: Bigrams of the 255 most frequent words (and the unknown word of a capped vocabulary) are counted in a dense table of 65,536 entries.
HEAD = 256
#: Bigrams seen less often in the whole corpus are not in the table, and back off.
LEAST = 2
BACKOFF = 0.4
#: Tokens of a bucket, on average, once there are more than this many buckets.
TOKENS = 4_000_000
BUCKETS = 64


def token_groups(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, all word hashes, and where each document's words end, for bounded groups of documents."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for a, b in groups(texts):
        yield ids[a:b], *hashed_words([t.encode() for t in texts[a:b]])


def vocabulary(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, int]:
    """(word, n) of all words; of the ``size`` most frequent the sorted hashes, rank (1 for the first) and count of each;
    and the corpus's number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, _ in token_groups(batch):
                w, n = np.unique(words, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "n"])

    counts = stored(docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = counts.orderBy(F.desc("n"), "word").limit(size).toArrow()
    words, n = top["word"].to_numpy().view(U), top["n"].to_numpy()
    order = np.argsort(words)
    return counts, words[order], order + 1, n[order], total


def lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


def score(docs: DataFrame, vocabulary_size: int | None = None, least: int = LEAST, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_tokens, log_score, per_token for every row.

    log_score sums log10 S over a document's words. S(w | v) is count(v w) / count(v) if the whole corpus has v w at
    least ``least`` times, else ``backoff`` * count(w) / tokens; the first word of a document always backs off, without
    the factor. Words are runs of characters other than blank and the controls 9 to 13, A-Z lower-cased. Texts that are
    null, empty or without words have no tokens, score 0 and a null per_token. Rows with equal doc_id are one document.
    Every word has its own count; only if ``vocabulary_size`` is given are all rarer words one unknown word.
    """
    if vocabulary_size is not None and vocabulary_size > KNOWN:
        raise ValueError(f"a capped vocabulary has at most {KNOWN} words")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty("text").alias("text"))
    table, words, ranks, counts, total = vocabulary(rows, KNOWN if vocabulary_size is None else vocabulary_size)
    unigrams = np.zeros(len(words) + 1, dtype=np.int64)
    unigrams[ranks] = counts
    unigrams[0] = total - counts.sum()
    sent = spark.sparkContext.broadcast((words, ranks, unigrams))
    buckets = max(BUCKETS, -(-total // TOKENS))

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, word ranks (hashes of words that have none), number of the document of every word, and places of words that follow another."""
        known, rank, _ = sent.value
        for ids, tokens, ends in token_groups(batch):
            at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
            w = np.where(known[at] == tokens, rank[at].astype(U), tokens if vocabulary_size is None else U(0)) if len(known) else np.zeros(len(tokens), U)
            doc = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
            yield ids, w, doc, np.flatnonzero(doc[1:] == doc[:-1]) + 1 if len(doc) else np.zeros(0, np.int64)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(HEAD * HEAD, dtype=np.int64)
        for batch in batches:
            for _, w, _, at in pairs(batch):
                both = (w[at] < HEAD) & (w[at - 1] < HEAD)
                table += np.bincount((w[at - 1][both] * U(HEAD) + w[at][both]).astype(np.int64), minlength=HEAD * HEAD)
        key = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(table[key])], ["key", "n"])

    frequent = rows.mapInArrow(dense, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most HEAD * HEAD rows
    head = np.zeros(HEAD * HEAD, dtype=np.int64)
    head[frequent["key"].to_numpy()] = frequent["n"].to_numpy()
    sent_head = spark.sparkContext.broadcast(head)

    def logs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        unigrams = sent.value[2]
        out = np.log10(backoff * np.maximum(unigrams[w], 1) / total)
        full = n >= least
        out[full] = np.log10(n[full] / unigrams[v[full]])
        return out

    schema = "doc long, tokens long, part double, word long, bucket int, bigrams array<int>, pairs array<long>"
    names = ["doc", "tokens", "part", "word", "bucket", "bigrams", "pairs"]

    def dealt(ids: pa.Array, d: np.ndarray, v: np.ndarray, x: np.ndarray, rare: bool) -> Iterator[pa.RecordBatch]:
        """Bigrams by document and bucket: two ranks in 32 bits, or two hashes if a word has no rank."""
        key = mix(v) * U(3) + x if rare else (v << U(16)) | x
        bucket = (mix(key) % U(buckets)).astype(np.int64)
        place = np.lexsort((bucket, d))
        owner = (d * buckets + bucket)[place]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        if m := len(starts):
            sizes, none = np.diff(np.append(starts, len(owner))), np.zeros(m, np.int64)
            two = np.stack([v[place], x[place]], axis=1).reshape(-1).view(np.int64) if rare else np.zeros(0, np.int64)
            one = np.zeros(0, np.int32) if rare else key[place].astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(owner[starts] // buckets)), pa.array(none), pa.array(np.zeros(m)), pa.nulls(m, pa.int64()), pa.array((owner[starts] % buckets).astype(np.int32)), lists(none if rare else sizes, one, pa.int32()), lists(2 * sizes if rare else none, two, pa.int64())], names=names
            )

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First words and frequent bigrams are scored here; other bigrams go to the bucket that counts them."""
        unigrams = sent.value[2]
        for batch in batches:
            for ids, w, doc, at in pairs(batch):
                n, ids = len(ids), pa.array(ids, pa.int64())
                v, x, d = w[at - 1], w[at], doc[at]
                both = (v < HEAD) & (x < HEAD)
                rare = (v >= LIMIT) | (x >= LIMIT)
                fv, fx = v[both].astype(np.int64), x[both].astype(np.int64)
                part = np.bincount(d[both], weights=logs(fv, fx, sent_head.value[fv * HEAD + fx]), minlength=n)
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                begin, far = w[first], w[first] >= LIMIT
                part[doc[first]] += np.where(far, 0.0, np.log10(np.maximum(unigrams[np.where(far, U(0), begin).astype(np.int64)], 1))) - np.log10(max(total, 1))
                word, null = np.zeros(n, np.int64), np.ones(n, bool)
                word[doc[first[far]]], null[doc[first[far]]] = begin[far].view(np.int64), False
                none = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.bincount(doc, minlength=n)), pa.array(part), pa.array(word, mask=null), pa.array(np.full(n, -1, np.int32)), lists(none, np.zeros(0, np.int32), pa.int32()), lists(none, np.zeros(0, np.int64), pa.int64())], names=names
                )
                some = ~both & ~rare
                yield from dealt(ids, d[some], v[some], x[some], False)
                yield from dealt(ids, d[rare], v[rare], x[rare], True)

    def look_up(table: pa.Table) -> pa.Table:
        """Count a bucket's bigrams and join the counts to the documents' bigrams. Each then needs one word's count: that
        of a word without a rank leaves as (word, sign)."""
        unigrams = sent.value[2]
        one, two = table["bigrams"].combine_chunks(), table["pairs"].combine_chunks()
        m = len(table)
        keys = one.flatten().to_numpy().view(np.uint32)
        unique, which, n = np.unique(keys, return_inverse=True, return_counts=True)
        value = logs((unique >> 16).astype(np.int64), (unique & 0xFFFF).astype(np.int64), n)[which]
        part = np.bincount(np.repeat(np.arange(m), np.diff(one.offsets.to_numpy())), weights=value, minlength=m)

        v, x = two.flatten().to_numpy().view(U).reshape(-1, 2).T
        row = np.repeat(np.arange(m), np.diff(two.offsets.to_numpy()) // 2)
        _, which, n = np.unique(mix(mix(v) * U(3) + x), return_inverse=True, return_counts=True)
        full = n[which] >= least
        word, sign = np.where(full, v, x), np.where(full, -1, 1)
        far = word >= LIMIT
        value = np.where(full, np.log10(n[which]), np.log10(backoff / max(total, 1)))
        value += np.where(far, 0.0, sign * np.log10(np.maximum(unigrams[np.where(far, U(0), word).astype(np.int64)], 1)))
        part += np.bincount(row, weights=value, minlength=m)
        k, docs = int(far.sum()), table["doc"].combine_chunks()
        own = pa.table({"doc": docs, "part": pa.array(part), "word": pa.nulls(m, pa.int64()), "sign": pa.array(np.zeros(m, np.int32))})
        asked = pa.table({"doc": docs.take(pa.array(row[far])), "part": pa.array(np.zeros(k)), "word": pa.array(word[far].view(np.int64)), "sign": pa.array(sign[far].astype(np.int32))})
        return pa.concat_tables([own, asked])

    exploded = rows.mapInArrow(explode, schema)
    own = exploded.where("bucket < 0").select("doc", "tokens", "part", "word", F.lit(1).alias("sign"))
    rest = exploded.where("bucket >= 0").select("bucket", "doc", "bigrams", "pairs").groupBy("bucket").applyInArrow(look_up, "doc long, part double, word long, sign int")
    scored = stored(own.unionByName(rest.withColumn("tokens", F.lit(0).cast("long"))), "parts")
    asked = scored.where("word IS NOT NULL").join(table, "word").select("doc", F.lit(0).cast("long").alias("tokens"), (F.col("sign") * F.log10("n")).alias("part"))
    sums = scored.select("doc", "tokens", "part").unionByName(asked).groupBy("doc").agg(F.sum("tokens").alias("n_tokens"), F.sum("part").alias("log_score"))
    return sums.select(F.col("doc").alias("doc_id"), "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("per_token"))
