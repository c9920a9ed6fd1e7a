"""Language identification: word frequencies first, shorter and shorter character n-grams for words not known."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.chunks import PORTION, groups, portions
from strata.llm.common import fresh, worker_tables
from strata.llm.shingles import U, mix

#: The model learns from the whole texts of at most this many documents of each language, those with the smallest hash.
SAMPLE = 600
LONGEST = 4
#: Words remembered by a worker.
REMEMBERED = 100_000
UNKNOWN = "und"
#: The pipeline rejects documents whose language has a smaller share of the evidence.
LEAST = 0.4

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters. The pattern also takes numbers that are no decimal digits, which then part words."""
    words = WORD.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split()]


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring code points."""
    h = points[: len(points) - n + 1].astype(U)
    for j in range(1, n):
        h = mix(h) + points[j : len(points) - n + 1 + j]
    return mix(h + U(n))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """Log frequencies of words and n-grams by language; languages in order, which decides ties."""

    def __init__(self, counts: dict[tuple[str, int], dict[str, int]] | pa.Table) -> None:
        """Counts by language and length of the gram (0: whole words), or a table (lang, n, gram, c) of them."""
        if not isinstance(counts, pa.Table):
            rows = [(lang, n, g, c) for (lang, n), x in counts.items() for g, c in x.items()]
            counts = pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "n", "gram", "c"])
        self.langs = sorted(counts["lang"].unique().to_pylist())
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(LONGEST + 1):
            some = counts.filter(pc.equal(counts["n"], n))
            coded = some["gram"].combine_chunks().dictionary_encode()
            seen = coded.dictionary.to_pylist()
            table = np.full((len(seen), len(self.langs)), 0.5)
            where = np.array([self.langs.index(x) for x in some["lang"].to_pylist()], dtype=np.int64)
            np.add.at(table, (coded.indices.to_numpy(), where), some["c"].to_numpy())
            logs = np.log(table / (table.sum(axis=0) + 0.5))
            if n == 0:
                self.words, self.logs = {w: i for i, w in enumerate(seen)}, logs
            else:
                keys = np.array([gram_hashes(code_points(g), n)[0] for g in seen], dtype=U)
                order = np.argsort(keys)
                self.grams[n] = (keys[order], logs[order])
        self.forget()

    def forget(self) -> None:
        """Start again: no word has been met."""
        self.at, self.rows = {}, np.zeros((0, len(self.langs)))

    def evidence(self, words: list[str]) -> np.ndarray:
        """For every word the mean of the log frequencies of its longest n-grams that are known; none: nothing."""
        points = code_points("".join(f"<{w}>" for w in words))
        lengths = np.array([len(w) + 2 for w in words])
        owner = np.repeat(np.arange(len(words)), lengths)
        out, open_ = np.zeros((len(words), len(self.langs))), np.ones(len(words), dtype=bool)
        for n in range(LONGEST, 0, -1):
            keys, logs = self.grams[n]
            if not len(keys) or len(points) < n:
                continue
            first, last = owner[: len(owner) - n + 1], owner[n - 1 :]
            at = np.flatnonzero((first == last) & open_[first])
            h = gram_hashes(points, n)[at]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            word, place = first[at][hit], place[hit]
            times = np.bincount(word, minlength=len(words))
            found = times > 0
            for c in range(len(self.langs)):
                out[found, c] = np.bincount(word, weights=logs[place, c], minlength=len(words))[found] / times[found]
            open_ &= ~found
        return out

    def learn(self, words: set[str]) -> None:
        """Remember the log frequencies of words not met before, or their evidence if the model doesn't know them."""
        if len(self.at) + len(words) > REMEMBERED:
            self.forget()
        if new := list(words.difference(self.at)):
            known = np.array([self.words.get(w, -1) for w in new])
            rows = self.logs[known] if len(self.logs) else np.zeros((len(new), len(self.langs)))
            if (known < 0).any():
                rows[known < 0] = self.evidence([w for w, i in zip(new, known.tolist(), strict=True) if i < 0])
            self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, rows])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(texts) > 1 and any(t and len(t) > PORTION for t in texts):
            return [x for t in texts for x in self.predict([t])]
        parts = [list(portions(t)) if t else [] for t in texts]
        if sum(map(len, parts)) <= len(texts):  # all are short: their words are looked up together
            cut = [words_of(p[0]) if p else [] for p in parts]
            self.learn(set().union(*cut))
            return [self.decided(len(w), self.sum(w)) for w in cut]
        count, total = 0, np.zeros(len(self.langs))
        for p in parts[0]:
            words = words_of(p)
            self.learn(set(words))
            count, total = count + len(words), total + self.sum(words)
        return [self.decided(count, total)]

    def sum(self, words: list[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)

    def decided(self, count: int, total: np.ndarray) -> tuple[str, float]:
        if not count or not self.langs:
            return UNKNOWN, 0.0
        total = total / np.sqrt(count)  # else the score of any long text would be 1
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training (a null doc_id counts as an empty one)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of documents that are not held out. The sample is bounded by SAMPLE documents of a
    language; all their words and n-grams make the model, which is what comes to the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    # About twice the sample has a hash below its language's limit, so that no more than that is ranked in one task.
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    limits = docs.sparkSession.createDataFrame([(lang, min(1 << 30, (2 * SAMPLE << 30) // n)) for lang, n in held.items()], "__lang string, __limit long")
    dice = F.xxhash64("doc_id", "text")
    near = rows.join(F.broadcast(limits), F.col("lang") == F.col("__lang")).where(F.pmod(dice, F.lit(1 << 30)) < F.col("__limit"))
    first = Window.partitionBy("lang").orderBy(F.pmod(dice, F.lit(1 << 30)), dice)
    sample = near.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= SAMPLE).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        by: dict[tuple[str, int], Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            rows = [(lang, n, g, c) for (lang, n), x in by.items() for g, c in x.items()]
            by.clear()
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "n", "gram", "c"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, c in Counter(words_of(text)).items():
                    by[lang, 0][word] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams(word, n):
                            by[lang, n][g] += c
                if sum(map(len, by.values())) > 500_000:
                    yield flush()
        yield flush()

    table = sample.mapInArrow(count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    return Model(table.toArrow())


def identify(docs: DataFrame, model: Model | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the chosen language's share of the evidence), or other names;
    columns that have these names are replaced.

    Only the text is used, all of it, however long. A null text and one without letters are ``und`` with score 0, and so
    is every text if no labelled document could be learned from. Equal evidence goes to the first language in order.
    Repeated rows are predicted alike. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    held = [c for c in docs.columns if c not in names]
    at = held.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables()
        own = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = [x for a, b in groups(texts_or_empty(texts)) for x in own.predict(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*held, *names])
        own.forget()  # the worker may live on

    own = [F.col(f"`{c}`") for c in held]
    schema = docs.select(*own).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema
    return docs.select(*own).mapInArrow(predict, schema)


def texts_or_empty(texts: list[str | None]) -> list[str]:
    return [t or "" for t in texts]


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, as ``identify`` says; a null doc_id is held out like an empty one."""
    own = docs.select("doc_id", "text", "lang")
    return identify(own.select("doc_id", "text"), train(own)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents whose language is known with at least this score, with their own columns, whatever their names."""
    names = (fresh(docs, "__lang_pred"), fresh(docs, "__score"))
    rows = identify(docs, train(docs.select("doc_id", "text", "lang")), names)
    return rows.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
