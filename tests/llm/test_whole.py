"""Operators that do the whole job where a bound once cut it."""

from __future__ import annotations

import collections
import math
import random

import pytest

from strata.llm import lm_score
from strata.llm.common import prepare


def test_op7_every_rare_word_has_its_own_count(spark):
    prepare(spark)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(120_000)}" for _ in range(1500)) for _ in range(80)]
    texts += [texts[0], texts[1], "w1 " + " ".join(f"once{i}" for i in range(50)), "", "the the"]
    w = {i: t.split() for i, t in enumerate(texts)}
    uni = collections.Counter(x for v in w.values() for x in v)
    bi = collections.Counter(p for v in w.values() for p in zip(v, v[1:], strict=False))
    total = sum(uni.values())
    assert len(uni) > 70_000  # more than a broadcast table of words holds
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert len(got) == len(w)
    for d, v in w.items():
        s = math.log10(uni[v[0]] / total) if v else 0.0
        for p in zip(v, v[1:], strict=False):
            s += math.log10(bi[p] / uni[p[0]]) if bi[p] >= 2 else math.log10(0.4 * uni[p[1]] / total)
        assert got[d]["n_tokens"] == len(v) and got[d]["log_score"] == pytest.approx(s)


def test_op4_complete_round_always_runs(spark, monkeypatch):
    from strata.llm import parity_join

    prepare(spark)
    rounds, survivors = [], parity_join.ParityJoin.survivors
    monkeypatch.setattr(parity_join.ParityJoin, "survivors", lambda self, rows, every: rounds.append(every) or survivors(self, rows, every))
    texts = [" ".join(f"d{i}w{j}" for j in range(60)) for i in range(5)]
    out = parity_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert rounds == [False, True] and all(r["component_id"] == r["doc_id"] for r in out)
