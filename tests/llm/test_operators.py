import collections
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwalk.llm import binary_output, decontamination, language_id, license_scan, near_duplicates, pii, sentencepieces, simple8b, token_counts, topk_search, url_filter
from driftwalk.llm.pieces import PieceCoder, PieceCounter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_tokens string, start string, spans string, fp string, lang string"
ODD = [None, "", "  ", "a", "foo  bar\n\n x.\tb", "<|endoftext|> ä ß É, 日本語 é", "Foo.\nBar, baz!! 's don't\r\n", "x" * 30_000, "ab " * 20_000]


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z", "w", "en") for i, t in zip(ids, texts, strict=True)], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- 10 and 5

def test_simple8b_roundtrip():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(0, 400), dtype=np.uint64) >> rng.integers(0, 64, dtype=np.uint64)
        if len(a) > 5:
            a[3:5] = 0, (1 << 64) - 1
        block = int(rng.choice([4, 64, 1024]))
        data = simple8b.encode(a, block)
        assert (simple8b.decode(data) == a).all()
        if len(a) > 2 * block:
            assert (simple8b.decode(data, 1, 2) == a[block : 2 * block]).all()
    with pytest.raises(ValueError):
        simple8b.decode(b"X" * 64)


def test_pieces_equal_the_library():
    for name, tool in (("byte_bpe_50k.json", PieceCoder), ("word_bpe_49k.json", lambda p: PieceCounter(p, {"the": 1}))):
        path = public_tokenizers.path(name)
        known, own = Tokenizer.from_file(path), tool(path)
        want = [known.encode(t or "", add_special_tokens=False).ids for t in ODD]
        if isinstance(own, PieceCoder):
            flat, counts = own.encode(ODD)
            assert flat.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
        else:
            assert own.count(ODD) == list(map(len, want))


def test_binary_output(spark, tmp_path):
    path, known = public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = frame(spark, [*ODD, "tie", "tie"], [*range(len(ODD), 0, -1), 1, 1])
    binary_output.write_ids(docs, str(tmp_path / "ids"), path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in binary_output.read_documents(spark, str(tmp_path / "ids")).collect())
    start, ids = 0, []
    for at, doc, n, crc in got:
        assert at == start
        start += n
        ids.append(doc)
    assert ids == sorted(ids) and len(got) == len(ODD) + 2
    want = {i: known.encode(t or "", add_special_tokens=False).ids + [0] for i, t in zip(range(len(ODD), 1, -1), ODD, strict=False)}
    assert all((n, crc) == (len(want[d]), zlib.crc32(np.array(want[d], "<u4").tobytes())) for _, d, n, crc in got if d > 1)
    assert {r.doc_id: r.ids for r in binary_output.read_ids(spark, str(tmp_path / "ids")).collect()}[5] == want[5]
    binary_output.write_ids(docs.limit(0), str(tmp_path / "none"), path)
    assert binary_output.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_token_counts(spark):
    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(token_counts.count_tokens(frame(spark, ODD), public_tokenizers.path("word_bpe_49k.json"), limit=100))
    for i, t in enumerate(ODD):
        n = len(known.encode(t or "", add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 100)
    assert token_counts.unpack_lengths(token_counts.pack_lengths({"a": 1, "é": 3})) == {"a": 1, "é": 3}
    assert token_counts.count_tokens(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


# ---- 9

def test_fm_index_equals_comparison():
    random.seed(3)
    for _ in range(60):
        items = [(random.choice([1, 2, 10, None]), " ".join(random.choice("abcdef") for _ in range(random.randint(0, 9)))) for _ in range(4)]
        texts = [random.choice([None, " ".join(random.choice("abcdefxyz") for _ in range(random.randint(0, 80)))]) for _ in range(5)]
        for t, (n, spans, found) in zip(texts, decontamination.shard_hits(texts, decontamination.Phrases(items, 3)), strict=True):
            assert (n, sum(b - a for a, b in spans), sorted(found)) == decontamination.naive_hits(t, items, 3)[:3]


def test_contamination_frames(spark, monkeypatch):
    docs = frame(spark, [None, "", "A b, c D e f g h i j k", "a b c", "q " * 5000 + "a b c d e f g h i j"])
    items = spark.createDataFrame([(10, "a b c d e f g h i j", 1), (9, "B c d E f g h i j k", 1), (9, "b c d e f g h i j k", 1), (3, None, 1), (None, "a b", 1)], "item_id long, text string, doc_id int")
    want = None
    for size in (10**6, 12):  # one block of items, and several
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", size)
        got = by_id(decontamination.contamination_report(decontamination.find_contamination(docs, items)))
        assert [(got[k].n_words, got[k].n_hit, got[k].n_items) for k in range(5)] == [(0, 0, 0), (0, 0, 0), (11, 11, 2), (3, 2, 0), (5010, 10, 1)]
        want = want or got
        assert want == got
    assert decontamination.find_contamination(docs, items.limit(0)).where("size(spans) > 0").count() == 0


# ---- 8

def test_language_scores_equal_brute_force():
    letters = language_id.Letters(64)
    texts = ["The cat!", None, "12 34", "a", "x  y--z É"]
    counts, trigrams, alphabet, has = language_id.trigram_counts(texts, letters)
    bound = counts @ letters.bind(trigrams, alphabet).astype(float)
    assert has.tolist() == [True, False, False, True, True]
    for t, got in zip(texts, bound, strict=True):
        s = " " + re.sub(r"[^a-zé]+", " ", (t or "").lower()) + " "
        if not has[texts.index(t)]:
            continue
        want = sum(np.roll(letters.vector(ord(a)), 2).astype(int) * np.roll(letters.vector(ord(b)), 1) * letters.vector(ord(c)) for a, b, c in zip(s, s[1:], s[2:], strict=False))
        assert (want == got).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95
    none = language_id.identify(frame(spark, ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert by_id(language_id.identify(frame(spark, ODD)))[0].lang_pred == "und"


# ---- 6

def test_topk_equals_comparison(spark):
    rng = np.random.default_rng(2)
    vectors = [rng.normal(size=8).round(1).tolist() for _ in range(150)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None] * 4), (902, [float("nan")] * 8), (903, [0.0] * 8), (None, vectors[0]), (60, vectors[60]), (904, vectors[1][:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and not any(map(math.isnan, v))]
    for q in (0, 20, 40, 80):
        own = dict(usable)[q]
        want = sorted(((i, sum(a * b for a, b in zip(own, v, strict=False))) for i, v in usable if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == want
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_lists_stop_early():
    rng = np.random.default_rng(1)
    lists = topk_search.SortedLists(np.arange(4096), (rng.exponential(size=(4096, 4)) ** 3 * 64).astype(np.int64))
    _, _, read = lists.top(0, np.array([5, 0, 0, 1]), 10, None)
    assert read < 2 * 4096


# ---- 4

def brute_components(texts):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return [len(s) for s in sets], root


def test_near_duplicates(spark, monkeypatch):
    random.seed(5)
    base = [str(random.randint(0, 10**6)) for _ in range(200)]
    texts = [None, "", " \t", "a b", "A  B", "a b c", " ".join(base), " ".join(base).upper()]
    for _ in range(40):
        other = list(base)
        for _ in range(random.randint(1, 9)):
            other[random.randrange(200)] = "new"
        texts.append(" ".join(other))
    sizes, roots = brute_components(texts)
    for chunk in (4096, 8):  # whole groups, and groups cut into chunks
        monkeypatch.setattr(near_duplicates, "BUCKET_CHUNK", chunk)
        monkeypatch.setattr(near_duplicates, "CLUSTER_CHUNK", chunk * 500)
        got = by_id(near_duplicates.near_duplicates(frame(spark, texts)))
        assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(sizes[i], roots[i], roots[i] == i) for i in range(len(texts))]
    assert near_duplicates.near_duplicates(frame(spark, [])).count() == 0
    null = near_duplicates.near_duplicates(frame(spark, ["a b", "a b"], [None, 4]))
    assert {(r.doc_id, r.component_id, r.kept) for r in null.collect()} == {(None, None, False), (4, 4, True)}


def test_odd_sketch_estimates():
    rng = np.random.default_rng(7)
    for share in (0.75, 0.9):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(2000 * share), int(1000 * (1 - share)), int(1000 * (1 - share))))
        x, y = (np.frombuffer(near_duplicates.odd_sketch(near_duplicates.min_hashes(np.concatenate([common, o]))), np.uint64) for o in (a, b))
        j = len(common) / (len(common) + len(a) + len(b))
        assert abs(near_duplicates.estimated_similarity(int(np.bitwise_count(x ^ y).sum())) - j) < 0.15


# ---- 3

def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://example.net", "http://x.net/", "https://example.com/de/1", "http://a.org/fr/2", "http://notexample.com/de/", "x://h?u=http://y.net/"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert (got[0].host, got[0].path, got[0].rule) == ("", "", None) and got[2].host == ""
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[4].path, got[4].rule) == ("", None) and got[5].rule == "net/" and got[6].rule == "example.com/de/" and got[7].rule == "org/fr/" and got[8].rule is None
    assert (got[9].host, got[9].path) == ("h", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    model = url_filter.BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


# ---- 1

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(re.sub("[^0-9]", "", s))))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def test_personal_data(spark):
    random.seed(1)
    texts = [*ODD, "a@b.c_d@e.f a@b.c@d.e 😀x@y.zz", "1.2.3.4.5.6.7.8 0255.0.0.01 256.1.1.1", "4111 1111-1111 1111 x 41111111111111112", "+1 (988) 555-2485 +12-345 +4(", 'token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "9" * 30_000, "a@" + "b." * 20_000 + "c"]
    texts += ["".join(random.choice("a1@.+- 4_") for _ in range(60)) for _ in range(150)]
    got = by_id(pii.report(pii.find_personal_data(frame(spark, texts), ["doc_id"])))
    for i, t in enumerate(texts):
        want = [f"{k}:{m.start()}:{m.end()}" for k, p, f in BASE for m in re.finditer(p, t or "") if f(m.group())]
        have = [s for s in got[i].spans.split(",") if s]
        assert set(want) <= set(have) and got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone == len(want)
    found = pii.find_personal_data(frame(spark, ["mail 😀 a@b.cc now"]), ["text"])
    assert found.select(pii.redacted(F.col("text"), F.col("spans"))).first()[0] == "mail 😀 [email] now"
    assert pii.find_personal_data(frame(spark, []), ["doc_id"]).count() == 0


def test_estimated_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.4
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) * 2 - 1 for a in (0.95, 0.8, 0.7, 0.6)], axis=1)
    pattern, counts = np.unique(votes, axis=0, return_counts=True)
    _, reliability = pii.estimate(pattern, counts.astype(float), rounds=200)
    assert np.allclose(reliability[1, :, 2], [0.95, 0.8, 0.7, 0.6], atol=0.06)


# ---- 7

def test_licenses(spark):
    mit = dict(license_scan.TEMPLATES)["MIT-long"]
    below, above = mit.replace("person", "one"), mit.replace("Permission", "One")  # 11 and 15 of 16 shingles are left
    docs = frame(spark, [None, "", "Released under the MIT License.", "x y " * 3000 + mit + " z" * 9, below, "licensed under nothing at all here", above])
    got = {(r.doc_id, r.license): r for r in license_scan.scan(docs).collect()}
    assert set(got) == {(2, "MIT"), (3, "MIT-long"), (6, "MIT-long")} and got[6, "MIT-long"].n_found == 15
    assert got[3, "MIT-long"].start_word == 6000 and got[3, "MIT-long"].n_found == got[3, "MIT-long"].n_shingles
    assert license_scan.scan(docs.limit(0)).count() == 0


# ---- 2

@pytest.fixture(scope="module")
def model():
    return sentencepieces.worker_model(public_tokenizers.path("piece_bpe_32k.model"))


def segmentations(model, s):
    if not s:
        yield (), 0.0
    for n in range(1, len(s) + 1):
        key = np.zeros(1, np.uint64)
        for c in s[:n]:
            key = model._extend(key, np.array([ord(c)], np.uint64))
        piece = int(model.lookup(key)[0])
        if piece >= 0:
            for rest, w in segmentations(model, s[n:]):
                yield (piece, *rest), w + model.weights[piece]


def test_gumbel_samples(model):
    weights = dict(segmentations(model, "▁ther"))
    total = np.logaddexp.reduce(list(weights.values()))
    n = 3000
    rows = sentencepieces.sample_rows(model, list(range(n)), ["ther"] * n, 3, 7, True)
    first, chosen, inverse = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for doc, number, _, ids, _, log_p, _, inclusion, same in rows:
        assert same and abs(log_p - (weights[tuple(ids)] - total)) < 1e-6
        chosen[doc].add(tuple(ids))
        first[tuple(ids)] += number == 1
        inverse[tuple(ids)] += 1 / inclusion
    assert all(len(x) == 3 for x in chosen.values())
    top = sorted(weights, key=weights.get)[-2:]
    for ids in top:
        assert abs(first[ids] / n - math.exp(weights[ids] - total)) < 0.04 and abs(inverse[ids] / n - 1) < 0.05


def test_samples_do_not_depend_on_the_run(model):
    texts = ["the cat sat on the mat " * n + str(n) for n in range(1, 60)]
    whole = sentencepieces.sample_rows(model, list(range(59)), texts, 3, 7, True)
    single = [row for i, t in enumerate(texts) for row in sentencepieces.sample_rows(model, [i], [t], 3, 7, True)]
    assert sorted(whole) == sorted(single)


def test_segmentation_frames(spark, model):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [*ODD, "z" * 2000, "a ▁b"]
    rows = sentencepieces.sample_segmentations(frame(spark, texts), path, k=2)
    got = collections.defaultdict(list)
    for r in rows.collect():
        got[r.doc_id].append(r)
        assert r.decodes
    assert len(got[0]) == 1 and got[0][0].n_pieces == 0
    back = {(r.doc_id, r.text) for r in sentencepieces.decode_ids(rows, path).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t in enumerate(texts)}
    again = {(r.doc_id, r.sample): r.ids for r in sentencepieces.sample_segmentations(frame(spark, texts).repartition(3), path, k=2).collect()}
    assert again == {(r.doc_id, r.sample): r.ids for x in got.values() for r in x}


# ---- pipeline

def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    ids = []
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == p.COLUMNS, name
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        ids.append({r.doc_id: r.text for r in kept.collect()})
    order = sorted(ids[0])
    _, roots = brute_components([ids[0][i] for i in order])
    assert set(ids[1]) == {order[r] for r in roots}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {i: decontamination.naive_hits(text[i], items, 10) for i in ids[1]}
    assert set(ids[2]) == {i for i, (words, hit, *_) in hits.items() if not hit or hit < words}
    assert all((ids[2][i] == text[i]) == (hits[i][1] == 0) and len(decontamination.words_of(ids[2][i])) == hits[i][0] - hits[i][1] for i in ids[2])
    assert set(ids[3]) == set(ids[2]) and not any(re.search(BASE[0][1], t or "") for t in ids[3].values())
    last = p.STAGES[-1][1](spark, kept, SF).toPandas()
    assert set(last.doc_id) == set(ids[3]) and last.decodes.all() and isinstance(last, pd.DataFrame)
