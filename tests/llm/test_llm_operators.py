"""The ten operators on odd documents against brute force, on empty tables and with clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import binary_output, hashing_index, language_id, lm_score, mixing, parity_join, sentencepiece_codec, sharding, suffix_dedup, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_id(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: r for r in rows}


def sets_of(texts, k):
    out = {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(LOW))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute_components(sets, num, den):
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_op1_ids_in_orc(spark, docs, clashing, empty, texts, tokenizer_path, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    binary_output.write_token_ids(clashing, str(tmp_path / "ids"), path)
    back = binary_output.read_token_ids(spark, str(tmp_path / "ids"))
    got, start = by_id(binary_output.digest(back)), 0
    stored = {r["doc_id"]: list(r["ids"]) for r in back.collect()}
    for d in sorted(texts):
        ids = tok.encode(texts[d], add_special_tokens=False).ids + [0]
        assert stored[d] == ids
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    one = back.where("doc_id = 9")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in one._jdf.queryExecution().executedPlan().toString()
    assert binary_output.encode_and_read_back(empty, path).count() == 0


def test_op1_generic_tokenizer_is_encoded_whole(tokenizer_path):
    own = binary_output.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert not own.known and own.encode(["Some words"]) == [own.whole("Some words")]


def test_op2_language(docs, clashing, empty):
    got = by_id(language_id.predictions(docs))
    rows = {r["doc_id"]: r for r in docs.collect()}
    for d, r in got.items():
        letters = bool(re.search(r"[^\W\d_]", rows[d]["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
    german = [d for d in got if (rows[d]["text"] or "").startswith("der und")]
    assert all(got[d]["lang_pred"] == "de" for d in german)
    other = by_id(language_id.identify(clashing, language_id.train(docs)).select("doc_id", "lang_pred", "score", "shard"))
    assert all(other[d]["lang_pred"] == got[d]["lang_pred"] and other[d]["shard"] == "clash" for d in got)
    assert language_id.predictions(empty).count() == 0
    unlabelled = by_id(language_id.predictions(docs.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in unlabelled.values()} == {"und"}


def test_op2_backs_off_to_shorter_grams():
    counts = {("a", 0): {"known": 9}, ("b", 0): {"other": 9}, ("a", 1): {"k": 9, "n": 9}, ("b", 1): {"o": 9}, ("a", 2): {"kn": 4}, ("b", 2): {"ot": 4}}
    m = language_id.Model(counts)
    one = np.array([m.grams[1][1][np.searchsorted(m.grams[1][0], language_id.gram_hashes(language_id.code_points(c), 1)[0])] for c in "nk"])
    assert m.evidence(["nxk"])[0] == pytest.approx(one.mean(axis=0))  # no bigram of it is known
    assert m.predict(["known", "otx", None, "7 !"])[0][0] == "a" and m.predict(["otx"])[0][0] == "b"
    assert m.predict([None, "7 !"]) == [("und", 0.0)] * 2


def test_op3_parity_and_round_trip(spark, docs, clashing, empty, texts, tokenizer_path):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(sentencepiece_codec.digest(docs, path))
    for d, t in texts.items():
        ids = own.encode(t)
        assert got[d]["ids_crc32"] == zlib.crc32(np.array(ids, "<i4").tobytes()) and got[d]["n_tokens"] == len(ids)
        assert got[d]["decoded_crc32"] == zlib.crc32(own.decode(ids).encode())
    coded = sentencepiece_codec.encode(clashing.select("doc_id", "text", "shard"), path)
    back = by_id(sentencepiece_codec.decode(coded.select("doc_id", "token_ids"), path))
    assert all(back[r["doc_id"]]["text"] == texts[r["doc_id"]] for r in coded.collect() if r["round_trip"])
    assert sentencepiece_codec.digest(empty, path).count() == 0
    codec = sentencepiece_codec.Codec(path)
    codec.encode(list(texts.values()))
    codec.encode_whole([t for t in texts.values() if t])
    assert codec.differ == 0
    assert codec.tokenizer.decode(own.encode("some text")) == "some text"


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_op4_components(clashing, texts, k, num, den):
    sets = sets_of(texts, k)
    want = brute_components(sets, num, den)
    got = by_id(parity_join.link_documents(clashing, k, num, den))
    assert {d: r["n_shingles"] for d, r in got.items()} == {d: len(s) for d, s in sets.items()}
    assert {d: r["component_id"] for d, r in got.items()} == want


def test_op4_empty_and_kept(spark, docs, empty):
    assert parity_join.link_documents(empty).count() == 0
    kept = parity_join.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 1 and kept.where("doc_id in (3, 6, 9)").count() == 0


def test_op4_pigeonhole_never_misses():
    """Any two sets within the bound share a key, at the sizes where bands begin and end too."""
    rng = random.Random(3)
    for num in (80, 90):
        sim = parity_join.Similarity(num, 100)
        for n in [*range(5, 60), 75, 99, 100, 150, 333]:
            a = np.array(sorted(rng.getrandbits(64) for _ in range(n)), dtype=np.uint64)
            drop = rng.randint(0, sim.room(n, n))
            for gone in range(drop + 1):
                keep = rng.sample(a.tolist(), n - gone)
                b = np.array(sorted(keep + [rng.getrandbits(64) for _ in range(drop - gone)]), dtype=np.uint64)
                both = len(np.intersect1d(a, b))
                if 100 * both >= num * (len(a) + len(b) - both):
                    same = len(np.intersect1d(parity_join.keys_of(a, sim), parity_join.keys_of(b, sim)))
                    assert same or np.array_equal(a, b), (num, n, gone, drop)


def brute_removed(texts):
    count = collections.Counter(b[i : i + 200] for b in texts.values() for i in range(len(b) - 199))
    out = {}
    for d, b in texts.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out[d] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [50_000, 2])
def test_op5_removes_repeats(clashing, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = brute_removed({d: t.encode() for d, t in texts.items()})
    got = by_id(suffix_dedup.removed(clashing))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want


def test_op5_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    t = random.Random(1).randbytes(5000)
    data, starts, ends, _, offset = zip(*suffix_dedup.laid_out([t]), strict=True)
    owned = sorted(q for d, s, e, o in zip(data, starts, ends, offset, strict=True) for text, _, first, n, _ in zip(*suffix_dedup.anchors(d, s, e), strict=True) for q in range(first - s[text] + o[text], first - s[text] + o[text] + n))
    assert owned == list(range(5000 - 199))


def test_op5_keeps_characters_and_rows(docs, empty):
    out = suffix_dedup.without_repeats(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("n_chars <> char_length(text)").count() == 0
    assert suffix_dedup.removed(empty).count() == 0


def test_op6_budgets_and_prefixes(docs, clashing, empty, texts):
    weights = {"lang": {"en": 3.0}, "source": {"src1": 0.0}}
    rows = mixing.select(clashing, share=0.5, max_epochs=2, weights=weights).collect()
    words = {d: len(WORD.findall(t)) for d, t in texts.items()}
    meta = {r["doc_id"]: r for r in docs.collect()}
    leaf, held = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["n_tokens"] == words[r["doc_id"]] and 0 < r["taken"] <= r["n_tokens"] and r["epoch"] in (0, 1, 2)
        leaf[r["domain"], r["lang"], r["source"]] += r["taken"]
    for d, n in words.items():
        s = meta[d]["source"]
        held[None if s is None else f"d{zlib.crc32(s.encode()) % 3}", meta[d]["lang"], s] += n
    assert not any(k[2] == "src1" for k in leaf) and all(leaf[k] <= 2 * held[k] for k in leaf)
    target = 0.5 * sum(words.values())
    assert target - len(held) <= sum(leaf.values()) <= target
    partial = collections.Counter((r["domain"], r["lang"], r["source"]) for r in rows if r["taken"] < r["n_tokens"])
    assert max(partial.values()) <= 1  # one document in which a leaf's budget ends
    assert mixing.select(empty).count() == 0
    cut = mixing.mixed(docs, 0.5, {})
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert (meta[r["doc_id"]]["text"] or "").startswith(r["text"]) and r["n_chars"] == len(r["text"])


def test_op6_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "x", "t", 1000), ("b", "x", "u", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, 0, 400, 1, {}).collect()}
    assert got == {"s": 10, "t": 190, "u": 200}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves.where("source <> 't'"), 0, 400, 1, {}).collect()}
    assert got == {"s": 10, "u": 390}


def test_op7_scores(clashing, empty, texts):
    got = by_id(lm_score.score(clashing, vocabulary_size=300))
    from strata.llm.shingles import hashed_words

    w = {d: WORD.findall(t.translate(LOW)) for d, t in texts.items()}
    count = collections.Counter(x for v in w.values() for x in v)
    top = set(sorted(count, key=lambda x: (-count[x], int(hashed_words([x.encode()])[0].view(np.int64)[0])))[:300])
    w = {d: [x if x in top else None for x in v] for d, v in w.items()}
    uni, total = collections.Counter(x for v in w.values() for x in v), sum(count.values())
    bi = collections.Counter(p for v in w.values() for p in zip(v, v[1:], strict=False))
    for d, v in w.items():
        s = math.log10(uni[v[0]] / total) if v else 0.0
        for p in zip(v, v[1:], strict=False):
            s += math.log10(bi[p] / uni[p[0]]) if bi[p] >= 2 else math.log10(0.4 * uni[p[1]] / total)
        assert got[d]["n_tokens"] == len(v) and got[d]["log_score"] == pytest.approx(s)
        assert (got[d]["per_token"] is None) == (not v)
    assert lm_score.score(empty).count() == 0


def test_op8_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows[40] = (40, None)
    rows[60] = (60, [0.0] * 16)
    rows[80] = (80, [float("nan")] * 16)
    rows[100] = (100, [None] + [1.0] * 15)
    rows[101] = (101, [1.0] * 5)
    rows[102] = (102, rows[200][1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "id": F.lit("clash")})
    got = collections.defaultdict(list)
    for r in hashing_index.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ok = [i for i, v in rows if i not in (40, 60, 80, 100, 101)]
    m = np.array([rows[i][1] for i in ok], dtype=np.float64)
    hit = 0
    queries = [i for i in ok if i % 20 == 0]
    assert sorted(got) == queries
    for q in queries:
        s = (m * np.array(rows[q][1])).sum(axis=1)
        best = [ok[i] for i in np.lexsort((ok, -s)) if ok[i] != q][:20]
        hit += len(set(best) & {v for v, _ in got[q]})
        assert len(got[q]) == 20 and all(abs(sc - s[ok.index(v)]) < 1e-12 for v, sc in got[q])
        assert [(-sc, v) for v, sc in got[q]] == sorted((-sc, v) for v, sc in got[q])
    assert hit / (20 * len(queries)) >= 0.9
    assert got[200][0][0] == 102 or 102 in [v for v, _ in got[200]]
    assert hashing_index.nearest(df.where("vec_id < 3")).count() == 2
    assert hashing_index.nearest(df.limit(0)).count() == 0


def brute_entries(text, k=5, w=8):
    """Positions of what any winnowing of these runs must choose, for given hashes of runs."""

    def pick(h):
        n = len(h)
        out = []
        for s in range(max(1, n - w + 1)) if n else ():
            window = h[s : s + w]
            at = s + max(i for i, v in enumerate(window) if v == min(window))
            if at not in out:
                out.append(at)
        return out

    return pick


def test_op9_fingerprints(spark, clashing, empty, texts):
    got = by_id(winnowing.fingerprints(clashing))
    order = sorted(texts, reverse=True)
    seen = {}
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        m = len(t) // 3
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert seen.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        a, b = ({x.split("@")[0] for x in got[e]["fingerprint"].split()} for e in (d, order[(i + 1) % len(order)]))
        assert got[d]["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert winnowing.fingerprints(empty).count() == 0


def test_op9_chooses_rightmost_minimum(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (1, 4, 5, 6, 12, 13, 40, 200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    runs = [(i, j, " ".join(t.split()[j : j + 5])) for i, t in enumerate(texts) for j in range(max(1, len(t.split()) - 4))]
    one = spark.createDataFrame(runs, "i int, j int, r string").select("i", "j", winnowing.entries(F.col("r"))[0]["h"].alias("h"))
    h = collections.defaultdict(dict)
    for r in one.collect():
        h[r["i"]][r["j"]] = r["h"]
    for r in df.select("i", winnowing.as_string(winnowing.entries(F.col("t"))).alias("f")).collect():
        got = [tuple(map(int, x.split("@"))) for x in r["f"].split()]
        hashes = [h[r["i"]][j] for j in range(len(h[r["i"]]))]
        assert [p for _, p in got] == brute_entries(texts[r["i"]])(hashes) and all(hashes[p] == v for v, p in got)


def test_op9_shared_passage_is_seen(spark):
    rng = random.Random(8)

    def text(n):
        return " ".join(str(rng.randint(0, 10**6)) for _ in range(n))

    passage = text(winnowing.W + winnowing.K - 1)
    df = spark.createDataFrame([(text(20) + " " + passage + " " + text(9), text(3) + " " + passage)], "a string, b string")
    assert df.select(F.size(F.array_intersect(winnowing.hashes(winnowing.entries(F.col("a"))), winnowing.hashes(winnowing.entries(F.col("b"))))).alias("n")).first()["n"] >= 1


def test_op10_exact_shards(spark, clashing, empty, texts):
    twice = clashing.unionByName(clashing)
    rows = sharding.shard_documents(twice, 7).collect()
    assert len(rows) == 2 * len(texts)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "rows", None)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_documents(twice, 7).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}
    assert sharding.shard_documents(empty).count() == 0


def test_op10_matrix_has_its_law():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 7, 13, 6) for _ in range(6000)]
    for k in range(7):
        p = math.comb(7, k) * math.comb(13, 6 - k) / math.comb(20, 6)
        assert draws.count(k) / 6000 == pytest.approx(p, abs=0.025)
    m = sharding.communication_matrix([5, 0, 9, 10], [8, 8, 8], 3)
    assert [sum(r) for r in m] == [5, 0, 9, 10] and [sum(c) for c in zip(*m, strict=True)] == [8, 8, 8]
    assert 0 <= sharding.hypergeometric(rng, 10**12, 10**12, 10**9) <= 10**9
