"""Mixing sources to target weights through a tree of domain, language and source (DataFrame functions only).

A node's weight is its share among its siblings. Budgets go down the tree: a node that holds less than its share gives
what is short to its siblings in proportion to their weights, and only a family that is short as a whole passes it up.
Each leaf then reads its documents in the order of seeded epochs until its budget of tokens is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import fresh, running_sum, small, stored, text_or_empty

LEVELS = ("domain", "lang", "source")
#: Target weights of the queries; siblings not named have weight 1.
WEIGHTS = {"domain": {"d0": 2.0}, "lang": {"en": 2.0}}
#: Rows of a bucket in which the running sum of a leaf is taken, on average, if all rows were in one leaf.
BUCKET_ROWS = 4096
WHITE = r"\x20\x09-\x0D"


def domain(source: Column, count: int = 3) -> Column:
    """A source's domain, where no other is given: d0 to d2 by its checksum; none for a null source."""
    return F.concat(F.lit("d"), (F.crc32(source.cast("binary")) % count).cast("string"))


def weight(level: str, weights: dict[str, float]) -> Column:
    """The given weight of a value, 1 for any other (and null)."""
    out = F.lit(1.0)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def fill(nodes: DataFrame, parents: list[str], order: str) -> DataFrame:
    """``budget`` of every node: its weight's share of ``parent_budget``, but no more than ``capacity``.

    In order of capacity over weight the first nodes are full; the level of the others is what is left over the weights
    that are left.
    """
    every = Window.partitionBy(*parents)
    w = every.orderBy(F.col("capacity") / F.col("weight"), order)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after)
    full = nodes.withColumn("__full", F.col("capacity") <= F.col("weight") * level * (1 + 1e-12))
    kept = F.sum(F.when(F.col("__full"), F.col("capacity")).otherwise(0.0)).over(every)
    left = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col("weight"))).over(every)
    return full.withColumn("budget", F.when(F.col("__full"), F.col("capacity")).otherwise(F.col("weight") * (F.col("parent_budget") - kept) / left)).drop("__full")


def budgets(leaves: DataFrame, share: float, total: int | None, max_epochs: float, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``leaves`` (levels, tokens; read more than once) with ``budget`` in whole tokens."""
    levels = list(LEVELS)
    nodes = leaves.withColumn("capacity", F.col("tokens") * float(max_epochs))
    for level in levels:
        nodes = nodes.withColumn("capacity", F.when(weight(level, weights.get(level, {})) > 0, F.col("capacity")).otherwise(0.0))
    held, capacity = nodes.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("capacity"), F.lit(0.0))).first()
    wanted = float(total) if total is not None else held * share
    above = nodes.where("capacity > 0").withColumn("parent_budget", F.lit(min(wanted, capacity)))
    for i, level in enumerate(levels):
        parents, own = levels[:i], levels[: i + 1]
        family = above.groupBy(*own).agg(F.sum("capacity").alias("capacity"), F.first("parent_budget").alias("parent_budget")).withColumn("weight", weight(level, weights.get(level, {})))
        filled = fill(family, parents, level).select(*[F.col(c).alias(f"__{c}") for c in own], F.col("budget").alias("__budget"))
        above = above.join(filled, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own]).withColumn("parent_budget", F.col("__budget")).drop("__budget", *[f"__{c}" for c in own])
    return above.select(*levels, "tokens", F.floor(F.col("parent_budget") + 1e-6).cast("long").alias("budget"))


def chosen(rows: DataFrame, share: float, total: int | None, max_epochs: int, weights: dict[str, dict[str, float]] | None, seed: int) -> DataFrame:
    """``rows`` (row, unique; dice; levels; n_tokens; others) that are stored, with what each epoch takes of them."""
    levels = list(LEVELS)
    sums = stored(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "leaves")
    leaves = stored(budgets(sums.drop("n"), share, total, max_epochs, weights or {}), "budgets")
    named = leaves.select(*[F.col(c).alias(f"__{c}") for c in levels], (F.col("budget") / F.col("tokens")).cast("long").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"))
    met = rows.join(small(named), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels]).drop(*[f"__{c}" for c in levels])
    met = met.withColumn("dice", F.xxhash64("dice", F.lit(seed), "whole"))
    bits = max(10, ((sums.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS).bit_length())
    placed = running_sum(met, levels, [F.col("dice"), F.col("row")], F.col("n_tokens"), F.shiftright("dice", 64 - bits), "before")
    last = F.least("n_tokens", F.greatest(F.col("rest") - F.col("before"), F.lit(0))).cast("long")
    full = F.transform(F.sequence(F.lit(1).cast("long"), F.col("whole")), lambda e: F.struct((e - 1).alias("epoch"), F.col("n_tokens").alias("taken")))
    full = F.when(F.col("whole") > 0, full).otherwise(F.array().cast("array<struct<epoch:bigint,taken:bigint>>"))
    each = F.concat(full, F.array(F.struct(F.col("whole").alias("epoch"), last.alias("taken"))))
    return placed.withColumn("each", F.explode(F.filter(each, lambda e: e["taken"] > 0))).select(*rows.columns, F.col("each.epoch").alias("epoch"), F.col("each.taken").alias("taken"))


def counted(docs: DataFrame, row: Column, tokens: Column | None, domains: Column | None) -> DataFrame:
    """(row, dice, doc_id, levels, n_tokens) of the rows that have tokens, stored."""
    text = text_or_empty("text")
    words = F.regexp_count(text, F.lit(f"[^{WHITE}]+")) if tokens is None else tokens
    of = domain(F.col("source")) if domains is None else domains
    found = docs.select(row.alias("row"), F.xxhash64("doc_id", text).alias("dice"), "doc_id", of.alias("domain"), "lang", "source", words.cast("long").alias("n_tokens"))
    return stored(found.where("n_tokens > 0"), "tokens")


def select(
    docs: DataFrame,
    share: float = 1.0,
    total: int | None = None,
    max_epochs: int = 2,
    weights: dict[str, dict[str, float]] | None = None,
    seed: int = 11,
    domains: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch, taken): what each epoch of each leaf takes of a document.

    Budgets sum to ``total`` tokens (or ``share`` of all), less what ``max_epochs`` passes cannot give. ``taken`` is
    less than ``n_tokens`` only for the one document in which a leaf's budget ends. Tokens are words, unless ``tokens``
    counts them otherwise; ``domains`` gives a document's domain. Null languages and sources are nodes of their own, null
    doc_ids are documents like any other; documents without tokens are never taken; repeated rows are taken one by one,
    and of equal ones it doesn't matter which. Texts of any length are counted whole; other columns are not used. An
    empty table gives an empty one.
    """
    rows = counted(docs, F.monotonically_increasing_id(), tokens, domains)
    return chosen(rows, share, total, max_epochs, weights, seed).drop("row", "dice")


def mixed(docs: DataFrame, share: float, weights: dict[str, dict[str, float]], seed: int = 11) -> DataFrame:
    """The chosen documents of one epoch with their own columns, whatever their names; of the one in which a leaf's budget
    ends, the words that it may still give. Rows are numbered, so repeated ones are told apart; what is said of nulls and
    empty texts at ``select`` holds here too."""
    names, row = docs.columns, fresh(docs, "__row")
    base = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    at, n, taken = (fresh(base, c) for c in ("__at", "__n", "__taken"))
    rows = chosen(counted(base, F.col(row), None, None), share, None, 1, weights, seed)
    rows = stored(rows.select(F.col("row").alias(at), F.col("n_tokens").alias(n), F.col("taken").alias(taken)), "chosen")
    met = base.join(small(rows), F.col(row) == F.col(at))
    pieces = F.split("text", f"(?<=[^{WHITE}])(?=[{WHITE}])")
    met = met.withColumn("text", F.when(F.col(taken) < F.col(n), F.array_join(F.slice(pieces, 1, F.col(taken).cast("int")), "")).otherwise(F.col("text")))
    if "n_chars" in names:
        met = met.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return met.select(*[F.col(f"`{c}`") for c in names])
