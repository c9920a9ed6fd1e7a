"""Repeated rows, equal and null doc_ids, long texts and clashing names; models that no file of the box has."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import binary_output, hashing_index, language_id, lm_score, mixing, parity_join, sentencepiece_codec, sharding, suffix_dedup, winnowing
from strata.llm.common import prepare
from tests_llm_data import DOCS, odd_documents, words


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat, one doc_id with two texts, null doc_ids."""
    prepare(spark)
    rows = odd_documents()
    more = [rows[0], rows[0], rows[20], (0, "another text of document nought with some words", "en", "src0", 1)]
    more += [(None, t, "en", "src1", 1) for t in (rows[0][1], rows[0][1], "a text without an id", None, "")]
    return rows + more, spark.createDataFrame(rows + more, DOCS).repartition(3).cache()


def rows_of(df):
    return collections.Counter(map(tuple, df.collect()))


def test_op1_equal_and_null_ids(spark, odd, tokenizer_path, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows, df = odd
    binary_output.write_token_ids(df, str(tmp_path / "ids"), path)
    got = sorted(binary_output.digest(binary_output.read_token_ids(spark, str(tmp_path / "ids"))).collect(), key=lambda r: r["start"])
    start = 0
    for r, row in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode())), strict=True):
        ids = tok.encode(row[1] or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op1_files_have_indexes(spark, tmp_path, tokenizer_path):
    """The footer names Bloom filter columns; a point read skips row groups."""
    import pyarrow.orc as orc

    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    binary_output.write_token_ids(df, str(tmp_path / "ids"), tokenizer_path("byte_bpe_50k.json"))
    files = sorted((tmp_path / "ids").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 30_000
    for f in files:
        assert orc.ORCFile(f).nstripes >= 1 and orc.ORCFile(f).row_index_stride == 1000
    read = binary_output.read_token_ids(spark, str(tmp_path / "ids")).where("doc_id = 12345")
    assert [r["doc_id"] for r in read.collect()] == [12345]


@pytest.mark.parametrize("portion", [60])
def test_long_texts_in_portions(monkeypatch, portion, tokenizer_path):
    from strata.llm import chunks

    for module in (binary_output, language_id, sentencepiece_codec):
        monkeypatch.setattr(module, "PORTION", portion)
    monkeypatch.setattr(chunks, "PORTION", portion)
    long = [r[1] for r in odd_documents() if r[1] and len(r[1]) > portion]
    one = binary_output.Encoder(tokenizer_path("byte_bpe_50k.json"))
    assert all(one.encode([t])[0] == one.whole(t) for t in long)
    own = sentencepiece_codec.Codec(tokenizer_path("piece_bpe_32k.model"))
    for t in long:
        ids, same = own.encode([t])
        assert np.frombuffer(ids[0], "<i4").tolist() == own.own.encode(t) and same == [True]
    m = language_id.Model({("a", 0): {"und": 9}, ("b", 0): {"other": 9}, ("a", 1): {"u": 9, "n": 9}, ("b", 1): {"o": 9}})
    parts = [m.predict([t])[0] for t in long]
    monkeypatch.setattr(language_id, "PORTION", 10**9)
    monkeypatch.setattr(chunks, "PORTION", 10**9)
    for (lang, score), t in zip(parts, long, strict=True):
        whole = m.predict([t])[0]
        assert lang == whole[0] and score == pytest.approx(whole[1])


def test_op1_pieces_met_again_stay_when_room_is_made(monkeypatch, tokenizer_path):
    rng = random.Random(11)
    own = binary_output.Encoder(tokenizer_path("byte_bpe_50k.json"))
    monkeypatch.setattr(binary_output, "REMEMBERED", 60)
    texts = ["\n", " ", "a ", "it's\nwe'll it's", "x\n", " two'' 's", "é'ü 12ab", "日本 語 ab", "\na b"]
    texts += [" ".join("".join(rng.choice("abc'.1é\n")[0] for _ in range(rng.randint(1, 5))) for _ in range(12)) for _ in range(60)]
    for i in range(0, len(texts), 3):
        assert own.encode(texts[i : i + 3]) == [own.whole(t) for t in texts[i : i + 3]]
        assert own.encode(["some common words"]) == [own.whole("some common words")]
    new = []
    monkeypatch.setattr(own, "encode_pieces", lambda x, known=own.encode_pieces: new.extend(x) or known(x))
    for i in range(20):
        text = "some common words " + " ".join(f"w{i}x{j}" for j in range(30))
        assert own.encode([text]) == [own.whole(text)]
    assert len(own.keys) <= 60 + 33 and not {" common", " words"} & set(new)


def test_op1_common_pieces_are_encoded_once(monkeypatch, tokenizer_path):
    """Pieces met in every call stay remembered, also when they are over half of those that may be."""
    monkeypatch.setattr(binary_output, "REMEMBERED", 512)
    own = binary_output.Encoder(tokenizer_path("byte_bpe_50k.json"))
    common, new = "".join(f" c{i}" for i in range(280)), []
    monkeypatch.setattr(own, "encode_pieces", lambda x, known=own.encode_pieces: new.extend(x) or known(x))
    for i in range(12):
        text = f"begin{common}" + "".join(f" n{i}x{j}" for j in range(240))
        assert own.encode([text]) == [own.whole(text)]
    assert sum(p[1] == "c" for p in new) < 4 * 280 and len(own.keys) <= 512


def test_op1_odd_pieces_in_little_room(monkeypatch, tokenizer_path):
    """Long, equal-looking and oddly spaced texts, remembered in little room, have the tokenizer's ids."""
    own = binary_output.Encoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(12)
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = [f"one{c}two {c}x" for c in spaces] + [f"{c}{c}" for c in spaces] + ["a", "a\0", "a\0\0", "", "\0" * 8, "\0" * 9, "<|endoftext|> a", "¿qué? «no»", "\u3001 \u3042"]
    texts += ["x" * n + f" {'é' * n}\n{'ab' * n}" for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 400)]
    texts += [" ".join("".join(rng.choice("abé1'.") for _ in range(rng.randint(1, 30))) for _ in range(40)) for _ in range(40)]
    for room, ids in ((1, 10), (8, 100), (64, 1000), (1 << 12, 1 << 20)):
        monkeypatch.setattr(binary_output, "REMEMBERED", room)
        monkeypatch.setattr(binary_output, "REMEMBERED_IDS", ids)
        for _ in range(2):
            rng.shuffle(texts)
            for i in range(0, len(texts), 7):
                assert own.encode(texts[i : i + 7]) == [own.whole(t) for t in texts[i : i + 7]]
    data = "".join(texts).encode()
    starts = np.array(sorted(rng.sample(range(len(data)), 3000)))
    stops = np.append(starts[1:], len(data))
    pairs = set(zip(*(h.tolist() for h in binary_output.piece_hashes(data, starts, stops)), strict=True))
    assert len(pairs) == len({data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)})


def test_op1_room_for_ids_is_bounded(monkeypatch, tokenizer_path):
    """Room is made in slices: what it takes for a moment doesn't grow with what is remembered."""
    monkeypatch.setattr(binary_output, "REMEMBERED_IDS", 400_000)
    own, largest = binary_output.Encoder(tokenizer_path("byte_bpe_50k.json")), []
    text = " ".join(f"w{i}" for i in range(40_000))
    own.encode([text])
    own.fill(np.zeros(400_000, dtype="<i4"))
    monkeypatch.setattr(binary_output, "gathered", lambda pool, start, length, known=binary_output.gathered: largest.append(len(start)) or known(pool, start, length))
    own.make_room()
    assert largest and max(largest) <= 1 << 14 and own.filled == len(own.pool) <= 200_000
    assert own.encode([text]) == [own.whole(text)]


def test_op1_sizes_are_read_without_the_ids(spark, odd, tokenizer_path, tmp_path, monkeypatch):
    """Only the checksums read the ids again."""
    binary_output.write_token_ids(odd[1], str(tmp_path / "ids"), tokenizer_path("byte_bpe_50k.json"))
    plans = []
    monkeypatch.setattr(binary_output, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    binary_output.digest(binary_output.read_token_ids(spark, str(tmp_path / "ids")))
    assert len(plans) == 1 and "Scan orc" in plans[0] and "ids:array" not in plans[0]


def test_op2_only_letters_make_a_language(spark, odd):
    rows, df = odd
    more = df.unionByName(spark.createDataFrame([(1001, "½ ²  ①", "de", "s", 1), (1002, "² a", "de", "s", 1)], DOCS))
    got = {r["doc_id"]: r for r in language_id.predictions(more).collect()}
    assert (got[1001]["lang_pred"], got[1001]["score"]) == ("und", 0.0) and got[1002]["lang_pred"] != "und"
    assert rows_of(language_id.predictions(df).select("doc_id")) == collections.Counter((r[0],) for r in rows)


def test_op2_against_brute_force(spark):
    rng = random.Random(6)
    alphabet = {"de": "abcdefgäöüß", "en": "abcdefghijk", "fr": "abcdeéèàçfg"}
    rows = [(i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40))), lang, "s", 1) for i in range(90) for lang in [rng.choice("de en fr".split())]]
    rows += [(200, "zzz ABC 12 éé", None, "s", 1), (201, None, "en", "s", 1), (202, "7 8", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    counts = {(lang, n): collections.Counter() for lang in alphabet for n in range(5)}

    def parts(text):
        return [w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]

    for d, t, lang, *_ in rows:
        if lang and t is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            for w in parts(t):
                counts[lang, 0][w] += 1
                for n in range(1, 5):
                    counts[lang, n].update(f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n))
    seen = {n: set().union(*(counts[lang, n] for lang in alphabet)) for n in range(5)}
    total = {k: sum(v.values()) + 0.5 * (len(seen[k[1]]) + 1) for k, v in counts.items()}

    def log(lang, n, g):
        return math.log((counts[lang, n][g] + 0.5) / total[lang, n])

    def evidence(lang, w):
        if w in seen[0]:
            return log(lang, 0, w)
        for n in range(4, 0, -1):
            if known := [g for i in range(len(w) + 3 - n) if (g := f"<{w}>"[i : i + n]) in seen[n]]:
                return sum(log(lang, n, g) for g in known) / len(known)
        return 0.0

    for r in language_id.predictions(df).collect():
        w = parts(dict((x[0], x[1]) for x in rows)[r["doc_id"]] or "")
        if not w:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sums = {lang: sum(evidence(lang, x) for x in w) / math.sqrt(len(w)) for lang in alphabet}
        best = max(sorted(sums), key=sums.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(math.exp(s - sums[best]) for s in sums.values()))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model(tmp_path, pieces, squeeze):
    """A model file by hand: unknown, two control pieces, the bytes, then ``pieces`` with scores."""
    every = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], *[(p, s, 1) for p, s in pieces]]
    out = b"".join(message(1, message(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(kind)) for p, s, kind in every)
    out += message(2, varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1) + varint(40 << 3) + varint(0))
    out += message(3, message(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(int(squeeze)) + varint(5 << 3) + varint(1))
    path = tmp_path / f"unigram_{squeeze}.model"
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("squeeze", [True, False])
def test_op3_unigram_model_with_byte_fallback(tmp_path, squeeze):
    import sentencepiece

    rng = random.Random(5)
    pieces = [("▁", -3.0), *[(c, -5.0 - i / 50) for i, c in enumerate("abcdefgh")]]
    grams = {"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(60)}
    pieces += [(p, -4.0 - len(p) + rng.random()) for p in sorted(grams)] + [("▁" + p, -4.5 - len(p) + rng.random()) for p in sorted(grams)]
    path = unigram_model(tmp_path, pieces, squeeze)
    own, theirs = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    texts += ["aé b", "日本", "", "  a  b ", "a\nb", "x y z"]
    ids, same = own.encode(texts)
    for t, x, s in zip(texts, ids, same, strict=True):
        assert s and np.frombuffer(x, "<i4").tolist() == theirs.encode(t), t
    assert own.decode([np.frombuffer(x, "<i4") for x in ids]) == [theirs.decode(theirs.encode(t)) for t in texts]


def test_op3_differences_are_reported(spark, tokenizer_path, monkeypatch):
    path = tokenizer_path("piece_bpe_32k.model")
    own = sentencepiece_codec.Codec(path)
    right = own.own

    class Other:
        def encode(self, texts, **_):
            return [[*x, 5] if "wrong" in t else x for t, x in zip(texts, right.encode(texts, num_threads=1), strict=True)]

        piece_to_id = right.piece_to_id

    own.own = Other()
    ids, same = own.encode(["all right", "one wrong piece", "  wrong too", "nothing"])
    assert same == [True, False, False, True] and own.differ == 2
    assert [np.frombuffer(x, "<i4").tolist() for x in ids] == right.encode(["all right", "one wrong piece", "  wrong too", "nothing"])


def test_op3_rows(odd, tokenizer_path):
    rows, df = odd
    out = sentencepiece_codec.digest(df, tokenizer_path("piece_bpe_32k.model"))
    assert rows_of(out.select("doc_id")) == collections.Counter((r[0],) for r in rows) and out.where("not parity").count() == 0
    extra = df.withColumns({"parity": F.lit("x"), "n_tokens": F.lit("x"), "a b": F.lit(1)})
    assert sentencepiece_codec.encode(extra, tokenizer_path("piece_bpe_32k.model")).where("parity and `a b` = 1").count() == len(rows)


def test_op4_equal_ids_are_one_document(spark):
    rng = random.Random(1)
    a, b = words(rng, 60), words(rng, 60)
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, words(rng, 60)), (None, a), (None, ""), (5, None)], "doc_id long, text string")
    got = rows_of(parity_join.link_documents(df).select("doc_id", "component_id"))
    assert got == collections.Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 1, (None, None): 2, (5, 5): 1})
    kept = parity_join.keep_one(df, 3, 90, 100).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(1, min(a, b)), (4, df.where("doc_id = 4").first()["text"]), (0, a), (0, ""), (5, "")])


def test_op4_crowded_cells_lose_nothing(spark):
    """A passage that all documents share fills crowded cells; near copies among them are found all the same."""
    rng = random.Random(9)
    passage = words(rng, 30)
    texts = []
    for _ in range(40):
        own = words(rng, 60).split(" ")
        texts.append(" ".join(own) + " " + passage)
        for _ in range(rng.randint(0, 2)):
            copy = list(own)
            copy[rng.randrange(60)] = "edit"
            texts.append(" ".join(copy) + " " + passage)
    from test_llm_operators import brute_components, sets_of

    by = dict(enumerate(texts))
    for k, num in ((5, 80), (3, 90), (1, 60)):
        got = {r["doc_id"]: r["component_id"] for r in parity_join.link_documents(spark.createDataFrame(list(by.items()), "doc_id long, text string"), k, num, 100).collect()}
        assert got == brute_components(sets_of(by, k), num, 100)


def test_op4_spare_cells(monkeypatch):
    """Two sets within the bound share a cell that neither may leave out, wherever crowded cells are."""
    rng = random.Random(4)
    for num in (60, 80):
        sim = parity_join.Similarity(num, 100)
        for n in (20, 70, 150, 260):
            for _ in range(12):
                a = np.array(sorted(rng.getrandbits(64) for _ in range(n)), dtype=np.uint64)
                drop = rng.randint(1, max(1, sim.room(n, n)))
                gone = rng.randint(0, drop)
                b = np.array(sorted(rng.sample(a.tolist(), n - gone) + [rng.getrandbits(64) for _ in range(drop - gone)]), dtype=np.uint64)
                both = len(np.intersect1d(a, b))
                if 100 * both < num * (len(a) + len(b) - both):
                    continue
                shared = set(np.intersect1d(parity_join.keys_of(a, sim), parity_join.keys_of(b, sim)).tolist())
                left = []
                for s in (a, b):
                    keys, more = parity_join.emitted(s, sim)
                    rank = collections.Counter()
                    kept = set()
                    for key, m in sorted(zip(keys.tolist(), more.tolist(), strict=True), key=lambda x: (x[0] not in shared, x[0])):  # the shared ones are the most crowded
                        rank[key & 255] += 1
                        if rank[key & 255] > m:
                            kept.add(key)
                    left.append(kept)
                assert left[0] & left[1], (num, n)


def test_op5_repeated_rows(odd):
    rows, df = odd
    count = collections.Counter(b[i : i + 200] for r in rows for b in [(r[1] or "").encode()] for i in range(len(b) - 199))
    want = collections.Counter()
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    assert rows_of(suffix_dedup.removed(df)) == want


def test_op5_and_op6_clashing_names(docs, clashing):
    extra = docs.withColumns({c: F.lit("clash") for c in ("row", "__row", "__spans", "__at", "__id", "key", "__n", "__taken", "at", "dice", "before", "each", "anchors", "h")})
    for f in (suffix_dedup.without_repeats, lambda d: mixing.mixed(d, 0.5, {}), lambda d: language_id.keep_identified(d.withColumns({"score": F.lit("s"), "lang_pred": F.lit("l")})), parity_join.keep_one):
        plain, clash = f(docs), f(extra)
        assert set(clash.columns) >= set(extra.columns)
        assert rows_of(clash.select("doc_id", "text")) == rows_of(plain.select("doc_id", "text"))
        assert clash.where("row <> 'clash' or __row <> 'clash' or key <> 'clash'").count() == 0
        if "score" in clash.columns:
            assert clash.where("score <> 's' or lang_pred <> 'l'").count() == 0


def test_op6_repeated_rows_keep_the_budget(odd):
    rows, df = odd
    n = {i: len([w for w in (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for i, r in enumerate(rows)}
    for share in (0.3, 1.0):
        taken = mixing.select(df, share=share, max_epochs=1).collect()
        leaves = len({(r["domain"], r["lang"], r["source"]) for r in taken})
        assert share * sum(n.values()) - leaves - 1 <= sum(r["taken"] for r in taken) <= share * sum(n.values()) + 1e-6
        cut = mixing.mixed(df, share, {})
        assert cut.columns == df.columns and sum(len((r["text"] or "").split()) for r in cut.collect()) == sum(r["taken"] for r in taken)


def test_op7_op9_op10_odd_rows(odd):
    rows, df = odd
    ids = collections.Counter((r[0],) for r in rows)
    assert rows_of(winnowing.fingerprints(df).select("doc_id")) == ids
    assert rows_of(sharding.shard_documents(df).select("doc_id")) == ids
    assert rows_of(lm_score.score(df).select("doc_id")) == collections.Counter(set(ids))


def test_stages_keep_clashing_columns(spark, clashing, tmp_path):
    rows = clashing.withColumns({"key": F.lit("k"), "__spans": F.lit(1)})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, rows, "").write.parquet(str(tmp_path / str(i)))
        done = spark.read.parquet(str(tmp_path / str(i)))
        assert done.columns == rows.columns and done.where("key <> 'k' or __spans <> 1 or score <> 'clash'").count() == 0
        rows = done
    assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() == rows.count()


def test_op9_edited_fingerprints_and_far_ids(spark):
    """near_edited and edited_fingerprint from the edited text itself, with ids far apart."""
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randint(0, 40))) for i in [*range(60), -(2**62), 2**62, 10**12]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, reverse=True)
    edited = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        m = len(t) // 3
        edited.append((d, t[: len(t) - m] + nxt[:m]))
    own = {r["d"]: r["f"] for r in spark.createDataFrame(edited, "d long, t string").select("d", winnowing.as_string(winnowing.entries(F.col("t"))).alias("f")).collect()}
    placed, _ = winnowing.with_next(df, rows=4)
    assert placed.select("__block").distinct().count() > 10
    for r in winnowing.fingerprints(df).collect():
        assert r["edited_fingerprint"] == own[r["doc_id"]]
        a, b = ({x.split("@")[0] for x in r[c].split()} for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_op8_radius_is_complete_and_a_share():
    """Probing finds exactly the codes within the radius; the share keeps recall as the table grows."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((30_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotations = hashing_index.learn_rotations(x[:2048], hashing_index.ROTATIONS, rounds=4)
    code = hashing_index.codes(x, rotations)
    words = np.ascontiguousarray(code).view(np.uint64)
    recall = {}
    for n in (3000, 30_000):
        index = hashing_index.Index(code[:n])
        some = range(0, n, n // 25)
        apart = {q: np.bitwise_count(words[:n] ^ words[q]).sum(axis=1) for q in some}
        radius = int(np.ceil(np.quantile(np.concatenate(list(apart.values())), max(hashing_index.SHARE, hashing_index.CANDIDATES / n))))
        hit = 0
        for q in some:
            rows = index.within(code[q], radius)
            assert np.array_equal(rows, np.flatnonzero(apart[q] <= radius))
            score = x[:n] @ x[q]
            score[q] = -9
            hit += len(np.intersect1d(rows, np.argsort(-score)[:20]))
        recall[n] = hit / 20 / len(some)
    assert min(recall.values()) >= 0.9


def test_op8_other_lengths_and_short_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8 if i % 3 else 5).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in hashing_index.nearest(df, share=0.001, least=1).orderBy("query_id", "rank").collect():  # hardly any code is near
        got[r["query_id"]].append(r["vec_id"])
    assert sorted(got) == [i for i in range(400) if i % 20 == 0] and all(len(v) == 20 for v in got.values())
    for q, found in got.items():
        same = [(float(np.dot(v, rows[q][1])), -i) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        assert found == [-i for _, i in sorted(same, reverse=True)[:20]]
