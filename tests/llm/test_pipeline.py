"""The stages one by one against what they should do to odd documents."""

from __future__ import annotations

import gc
import weakref

import pyarrow as pa

import corpus_pipeline
from strata.llm import binary_output, language_id, parity_join, sentencepiece_codec


def test_stages(spark, docs, texts, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near copies", "repeated passages", "mixture", "encoding"]
    out, rows = [], docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, rows, "").write.parquet(str(tmp_path / str(i)))
        rows = spark.read.parquet(str(tmp_path / str(i)))
        out.append(rows)
    told = {r["doc_id"] for r in language_id.predictions(docs).where("lang_pred <> 'und' and score >= 0.4").collect()}
    assert {r["doc_id"] for r in out[0].collect()} == told
    groups = parity_join.link_documents(out[0], corpus_pipeline.WORDS, corpus_pipeline.SIMILAR, 100)
    assert {r["doc_id"] for r in out[1].collect()} == {r["component_id"] for r in groups.collect()}
    assert {r["doc_id"] for r in out[2].collect()} == {r["doc_id"] for r in out[1].collect()}
    assert all(o.columns == docs.columns for o in out[:4])
    assert {r["doc_id"] for r in out[4].collect()} == {r["doc_id"] for r in out[3].collect()} <= {r["doc_id"] for r in out[2].collect()}
    assert out[4].where("n_tokens <> size(token_ids)").count() == 0


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_keeps_tables_of_one_operator(tokenizer_path):
    class Rows:
        def mapInArrow(self, handle, schema):
            return list(handle(iter([pa.table({"set": [1], "text": ["a b c d"]}).to_batches()[0]])))

    path = tokenizer_path("piece_bpe_32k.model")
    near = object.__new__(parity_join.ParityJoin)
    near.k, near.sim = 3, parity_join.Similarity(90, 100)
    for following in (lambda: binary_output.encoder(tokenizer_path("byte_bpe_50k.json")), lambda: near.cells(Rows(), False)):
        codec = weakref.ref(sentencepiece_codec.codec(path))
        assert sentencepiece_codec.codec(path) is codec()
        following()
        gc.collect()
        assert codec() is None
