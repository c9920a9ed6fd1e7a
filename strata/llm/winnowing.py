"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed, every run of K words gets one hash, and of each window of W consecutive runs the smallest hash is
chosen (the rightmost of equals) with its position. Any passage of at least W + K - 1 words that two texts share gives
both the same chosen hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import blocks_of, text_or_empty

K = 5
W = 8
#: Ranges of doc_id into which the table is cut by quantiles, before each is cut further by equal widths.
RANGES = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entries(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<h, back>> of chosen entries in order of position: the run's hash, and its position, counted in words
    from 0, times -1, so that the smaller hash wins and then the larger position. A text of fewer than k words has one
    run, all its words; a text without words has none."""
    blank = F.lower(text)
    for c in "\t\n\x0b\x0c\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(blank, " "), "")

    def ahead(a: Column, step: int, f: Callable[[Column, Column], Column]) -> Column:
        """f of every element and the one ``step`` further on (null past the end)."""
        return F.zip_with(a, F.slice(a, 1 + step, F.size(a)), f)

    def grow(a: Column, have: int, want: int, f: Callable[[Column, Column], Column], then: Callable[[Column], Column]) -> Column:
        """From values of runs of ``have`` to those of runs of ``want``: two runs that overlap or meet make a longer one."""
        if have >= want:
            return then(a)
        step = min(have, want - have)
        return let(ahead(a, step, f), lambda b: grow(b, have + step, want, f, then))

    def whole(a: Column, run: int) -> Column:
        return F.slice(a, 1, F.greatest(F.size(a) - (run - 1), F.lit(1)))

    def placed(runs: Column) -> Column:
        return F.transform(whole(runs, k), lambda x, i: F.struct(x.alias("h"), (-i).alias("back")))

    def changes(chosen: Column) -> Column:
        """One entry for windows, always neighbours, that choose the same."""
        return F.filter(chosen, lambda x, i: (i == 0) | (x["back"] != F.get(chosen, i - 1)["back"]))

    return let(
        F.transform(words, lambda x: F.xxhash64(x)),
        lambda h: grow(h, 1, k, lambda x, y: F.xxhash64(x, y), lambda runs: let(placed(runs), lambda p: grow(p, 1, w, lambda x, y: F.least(x, y), lambda m: let(whole(m, w), changes)))),
    )


def as_string(entry: Column) -> Column:
    """``hash@position`` of every entry, separated by blanks."""
    return F.array_join(F.transform(entry, lambda x: F.concat(x["h"].cast("string"), F.lit("@"), (-x["back"]).cast("string"))), " ")


def hashes(entry: Column) -> Column:
    return F.array_distinct(F.transform(entry, lambda x: x["h"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct hash arrays; two empty ones are alike (1), an empty and another are not (0)."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def with_next(docs: DataFrame, rows: int = 2048) -> tuple[DataFrame, Window]:
    """(doc_id, text, __guest, __block) so that the next row of the window is the next document in descending doc_id.

    Documents are dealt into blocks of doc_id: ranges between quantiles, each cut into equal widths, about ``rows`` rows a
    block wherever ids lie close or far. The first document of each block also stands, as a guest, at the end of the block
    before it; that of the first block at the end of the last.
    """
    ids = docs.agg(F.count("*").alias("n"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", [i / RANGES for i in range(RANGES)], 10_000).alias("cuts")).first()
    cuts = sorted({int(c) for c in ids["cuts"] or [0]})
    ends = [*cuts[1:], (ids["hi"] or 0) + 1]
    each = max(1, -(-blocks_of(ids["n"], rows) // RANGES))
    at = F.array_max(F.filter(F.transform(F.array(*map(F.lit, cuts)), lambda c, i: F.when(c <= F.col("doc_id"), i)), lambda i: i.isNotNull()))
    at = F.coalesce(at, F.lit(0))  # quantiles are nearly exact: an id may lie below the first
    low, width = (F.element_at(F.array(*map(F.lit, x)), at + 1).cast("decimal(20,0)") for x in (cuts, [max(1, -(-(e - c) // each)) for c, e in zip(cuts, ends, strict=True)]))
    inner = F.greatest(F.lit(0), F.least(F.lit(each - 1), F.floor((F.col("doc_id").cast("decimal(20,0)") - low) / width)))
    block = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at * each + inner).cast("long")
    base = docs.select("doc_id", text_or_empty("text").alias("text"), block.alias("__block"))
    order = Window.orderBy(F.desc("__block"))
    firsts = docs.select("doc_id", block.alias("__block")).groupBy("__block").agg(F.max("doc_id").alias("__first"))  # one row a block
    firsts = firsts.withColumn("__to", F.coalesce(F.lag("__block").over(order), F.min("__block").over(Window.partitionBy()))).withColumnRenamed("__block", "__of")
    at = base.join(F.broadcast(firsts), base["__block"] == firsts["__of"])
    is_first = F.col("doc_id").eqNullSafe(F.col("__first"))
    placed = at.select(
        "doc_id",
        "text",
        F.explode(
            F.when(is_first, F.array(F.struct(F.lit(0).alias("g"), F.col("__block").alias("b")), F.struct(F.lit(1).alias("g"), F.col("__to").alias("b")))).otherwise(
                F.array(F.struct(F.lit(0).alias("g"), F.col("__block").alias("b")))
            )
        ).alias("__at"),
    ).select("doc_id", "text", F.col("__at.g").alias("__guest"), F.col("__at.b").alias("__block"))
    return placed, Window.partitionBy("__block").orderBy("__guest", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    A null text is empty; an empty text has the empty fingerprint. The only document is its own next. Rows with equal
    doc_id follow each other in order of their texts, null ids come last. The table's other columns are not used.
    """
    placed, order = with_next(docs)
    n = F.char_length("text")
    m = F.floor(n / 3).cast("int")
    both = (
        placed.withColumn("__next", F.coalesce(F.lead("text").over(order), F.lit("")))
        .withColumn("__edited", F.concat(F.substring("text", F.lit(1), n - m), F.substring("__next", F.lit(1), m)))
        .select("doc_id", "__block", "__guest", "text", n.cast("long").alias("n_chars"), F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), entries(F.col("text"), k, w).alias("__a"), F.when(F.col("__guest") == 0, entries(F.col("__edited"), k, w)).alias("__b"))
        .withColumn("__c", F.lead("__a").over(order))
        .where("__guest = 0")
    )
    a, b, c = hashes(F.col("__a")), hashes(F.col("__b")), hashes(F.coalesce("__c", F.array().cast("array<struct<h:bigint,back:int>>")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("__a")).alias("fingerprint"),
        as_string(F.col("__b")).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"),
    )
