from __future__ import annotations

import random

import pytest

from strata.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, letters: str = "abcdeiou") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Copies, near copies, shared passages, nulls in every column, empty and long texts, odd characters."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 70)
    near = []
    for i in range(12):
        w = base.split(" ")
        w[i * 9] = f"edit{i}"
        near.append(" ".join(w))
    texts = [
        base, base, base, *near, None, "", " ", "\n\t", "one", "two words", "Two  Words", "a b c", "123 456 !!", "é ü ñ ß 日本語 ½ x²", "don't we'll\n\nSTOP",
        words(rng, 40) + " " + passage + " " + words(rng, 40), words(rng, 30) + "\n" + passage, passage + " tail", "ab " * 400, "x" * 3000, words(rng, 6000), "<|endoftext|> <s> ▁ \u0000",
        *[words(rng, rng.randint(3, 90)) for _ in range(12)], *["der und die " + words(rng, 30, "äöüßxz") for _ in range(8)],
    ]
    rows = [(i * 3, t, "de" if t and "und" in t else "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows[4] = (*rows[4][:2], None, None, None)
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(odd_documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def texts():
    return {r[0]: r[1] or "" for r in odd_documents()}


@pytest.fixture(scope="session")
def empty(spark):
    prepare(spark)
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("shard", "slot", "n", "key", "row", "token_ids", "lang_pred", "score", "label", "__row", "__block", "ids", "rank")
    return docs.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path
