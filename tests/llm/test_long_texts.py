"""Texts without blanks: equal results by either path, linear time, bounded memory."""

import random
import resource
import time

import numpy as np
import public_tokenizers
import pytest

from driftwalk.llm import language_id, sentencepieces


@pytest.fixture(scope="module")
def model():
    return sentencepieces.worker_model(public_tokenizers.path("piece_bpe_32k.model"))


def rows(model, text, k=2):
    return [tuple(r.values()) for batch in sentencepieces.sample_batches(model, [5], [text], k, 7) for r in batch.to_pylist()]


def unspaced(n, seed):
    rng = random.Random(seed)
    return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.5 else rng.choice("abcdefgh12345678+/") for _ in range(n))


def test_long_chunks_sample_as_short_ones_do(model, monkeypatch):
    text = unspaced(3000, 1) + " and words " + unspaced(700, 2)
    monkeypatch.setattr(sentencepieces, "BLOCK", 256)
    long = rows(model, text)
    monkeypatch.setattr(sentencepieces, "LONG", 10**9)
    short = rows(model, text)
    assert [(r[1], r[3], r[9]) for r in long] == [(r[1], r[3], r[9]) for r in short] and len(long) == 2
    assert all(np.allclose(a[5:8], b[5:8], rtol=0, atol=1e-5) for a, b in zip(long, short, strict=True))
    assert all(r[8] and r[9] == text for r in long)


def test_time_is_linear_without_blanks(model):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    took = []
    for n in (100_000, 1_000_000):
        text, began = unspaced(n, n), time.process_time()
        assert all(r[8] for r in rows(model, text))
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] and took[1] < 120
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_languages_without_blanks(monkeypatch):
    """Many trigrams: sums by blocks equal the table of counts, within time and memory."""
    letters = language_id.Letters(64)
    texts = ["The cat sat", unspaced(500, 3), None, "12", unspaced(80, 4)]
    counts, trigrams, alphabet, _ = language_id.trigram_counts(texts, letters)
    want = counts @ letters.bind(trigrams, alphabet).astype(float)
    for cells in (0, 10**9):
        monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
        monkeypatch.setattr(language_id, "BLOCK_TRIGRAMS", 50)
        t = language_id.Trigrams(texts, letters)
        assert (t.bundled(letters, np.arange(5), 5) == want).all()
        assert (t.bundled(letters, np.array([0, 1, 0, -1, 0]), 2) == [want[0] + want[4], want[1]]).all()
    monkeypatch.undo()
    letters, before = language_id.Letters(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    prototypes = np.random.default_rng(1).normal(size=(4, language_id.DIMENSIONS))
    for texts in ([unspaced(1_000_000, 5)], [unspaced(25, k) for k in range(10_000)]):
        began = time.process_time()
        cosine, has = language_id.scores(texts, prototypes, letters)
        assert has.all() and cosine.shape == (len(texts), 4) and time.process_time() - began < 60
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_labels_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate([("the cat sat on the mat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("the mat the cat", None), (None, "en"), ("5", "xx")])], "doc_id long, text string, lang string")
    want = sorted(map(tuple, language_id.identify(docs).collect()))
    monkeypatch.setattr(language_id, "LABELS", 1)
    assert sorted(map(tuple, language_id.identify(docs).collect())) == want
