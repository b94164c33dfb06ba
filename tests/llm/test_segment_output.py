import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from driftwalk.llm import queries, sentencepieces

TEXTS = [None, "", "The cat sat.", "ä 日本 x", "a b c d"]


def documents(spark):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_returns_ids_and_decoded_text(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_sentencepieces(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(len(TEXTS)))
    for r in rows:
        assert len(r.ids) == r.n_pieces and crc(r.ids) == r.ids_crc32 and r.text == (TEXTS[r.doc_id] or "")


def test_stage_returns_ids(spark):
    rows = corpus_pipeline.segment_stage(spark, documents(spark), "")
    assert all(len(r.ids) == r.n_pieces and crc(r.ids) == r.ids_crc32 for r in rows.collect())
    back = {(r.doc_id, r.text) for r in sentencepieces.decode_ids(rows, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert back == {(k, t or "") for k, t in enumerate(TEXTS)}
