"""Chunks that windows repeat are looked up once and kept; windows stay small, and no row changes."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from driftwalk.llm import sentencepieces

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def rows_of(model, texts):
    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "text": t} for k, t in enumerate(texts)], SCHEMA)
    found = [r for x in sentencepieces.sampled(model, [batch], 3, 7, True) for r in x.to_pylist()]
    return sorted(found, key=lambda r: (r["doc_id"], r["sample"]))


@pytest.mark.parametrize("most", [500_000, 300, 20])
def test_kept_chunks_change_no_row(monkeypatch, most):
    model = sentencepieces.worker_model(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"river stone {k} walks over the river over the bridge {k % 7} 東京 \U0001f600 tower" for k in range(60)] + [None, "", "x" * 900, "  two  blanks ", "▁"]
    alone = [{**r, "doc_id": k} for k, t in enumerate(texts) for b in sentencepieces.sample_batches(model, [k], [t], 3, 7) for r in b.to_pylist()]
    looked, build = [], sentencepieces.Lattice.__init__
    monkeypatch.setattr(sentencepieces, "WINDOW_BYTES", 400)
    monkeypatch.setattr(sentencepieces, "RUN_BYTES", 150)
    monkeypatch.setattr(sentencepieces.Kept.__init__, "__defaults__", (most,))
    monkeypatch.setattr(sentencepieces.Lattice, "__init__", lambda self, m, chunks: looked.extend(chunks) or build(self, m, chunks))
    assert rows_of(model, texts) == alone
    if most == 500_000:
        assert looked.count("▁river") == 1


def test_draws_of_single_numbers():
    key = np.array([2**63 + 12345], np.uint64)
    for sample, position, purpose in ((0, 0, 2), (1, 77, 3), (2, 10**6, 4)):
        assert sentencepieces.uniform(key, sample, np.array([position]), purpose)[0] == sentencepieces.uniform_one(int(key[0]), sample, position, purpose)


def test_windows_are_small():
    """A worker's memory follows the window: of a megabyte each, two workers and a heap of 1800 MB went over 3000 MB."""
    assert sentencepieces.WINDOW_BYTES <= 300_000 and sentencepieces.KEPT <= 150_000
