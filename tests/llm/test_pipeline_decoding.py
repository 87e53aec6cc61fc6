"""The pipeline's last stage decodes what it has encoded, by the state machine."""

import hashlib

import corpus_pipeline


def test_last_stage_decodes_its_ids(spark):
    texts = ["Plain words, 12 of them.", "", None, "Zażółć gęślą jaźń 😀", "a" * 3000]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r["doc_id"]: r for r in corpus_pipeline.byte_level_bpe(spark, docs, "").collect()}
    assert {i: r["decoded_sha256"] for i, r in rows.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows.values())
