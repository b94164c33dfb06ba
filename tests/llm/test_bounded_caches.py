import os
import random
import sys

import public_tokenizers
from tokenizers import Tokenizer

from driftwalk.llm import pieces, token_counts


def distinct_words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(n)]


def taken(cache):
    return sum(sys.getsizeof(d) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items()) for d in (cache.new, cache.old))


def test_caches_are_bounded_by_bytes(monkeypatch):
    """Mostly distinct words: what is held stays near two generations."""
    monkeypatch.setattr(pieces, "CACHE_BYTES", 1 << 20)
    words = distinct_words(60_000, 1)
    for name, tool in (("byte_bpe_50k.json", pieces.PieceCoder), ("word_bpe_49k.json", lambda p: pieces.PieceCounter(p, {"the": 1}))):
        path = public_tokenizers.path(name)
        own, known = tool(path), Tokenizer.from_file(path)
        for at in range(0, len(words), 2000):
            text = "the " + " ".join(words[at : at + 2000])
            want = known.encode(text, add_special_tokens=False).ids
            if name == "byte_bpe_50k.json":
                flat, _ = own.encode([text])
                assert flat.tolist() == want
                cache = own.rest
            else:
                assert own.count([text]) == [len(want)]
                cache = own.cache
            assert taken(cache) < 5 << 20


def test_frequent_parts_merge_all_partitions(spark):
    words = distinct_words(3000, 2)
    texts = [" ".join(words[k::7] + ["often", "x"] * (k + 1)) for k in range(40)] + [None, "", "a\0b often"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    assert token_counts.frequent_parts(docs, 2, 50) == ["often", "x"]
    assert token_counts.frequent_parts(docs.limit(0), 2, 50) == []


def test_what_the_library_returns_is_bounded():
    """Missing parts are encoded a bounded number of characters at a time, in their order."""
    seen = []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            seen.append(sum(map(len, texts)))
            return [type("Got", (), {"ids": [len(t)]}) for t in texts]

    texts = ["a" * n for n in (3, pieces.AT_ONCE, 5, *[pieces.AT_ONCE // 4] * 9, 1)]
    assert [ids for ids in pieces.encoded(Counting(), texts)] == [[len(t)] for t in texts]
    assert max(seen) <= pieces.AT_ONCE and len(seen) == 5


def test_a_worker_encodes_in_one_thread(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    pieces.library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
