"""Repeated rows, ties, empty tables and nulls, operator by operator."""

import random

import public_tokenizers

import corpus_pipeline
from driftwalk.llm import decontamination, language_id, near_duplicates, pii, sentencepieces, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


def repeated(spark):
    return documents(spark, [(1, "mail a@b.cc now", "en"), (1, "mail a@b.cc now", "en"), (1, "other words here", "en"), (None, None, None)])


def test_repeated_rows_are_judged_each(spark):
    docs = repeated(spark)
    items = spark.createDataFrame([(7, "a@b.cc now"), (7, "a@b.cc now")], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    spans = sorted(r.spans for r in pii.report(pii.find_personal_data(docs, ["doc_id"])).collect())
    assert spans == ["", "", "email:5:11", "email:5:11"]
    counts = [(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()]
    assert sorted(counts, key=str) == sorted([(1, n) for n in (counts_of("mail a@b.cc now"), counts_of("mail a@b.cc now"), counts_of("other words here"))] + [(None, 0)], key=str)
    hits = sorted(r.n_hit for r in decontamination.contamination_report(decontamination.find_contamination(docs, items)).collect())
    assert hits == [0, 0, 4, 4]
    assert sorted((r.lang_pred for r in language_id.identify(docs).collect()), key=str) in (["en", "en", "en", "und"], ["und"] * 4)  # one id: held out or not
    samples = [tuple(r) for r in sentencepieces.sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()]
    assert len(samples) == 7 and len({str(r) for r in samples}) == 5


def counts_of(text):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)


def test_repeated_ids_with_different_texts(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(5, long, "en"), (5, "quite another text of its own", "en"), (9, long + " more", "en"), (9, "a b", "en")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(documents(spark, rows)).collect())
    assert got == [(5, 2, 5), (5, 46, 5), (9, 1, 9), (9, 47, 5)]


def test_links_near_the_threshold_are_found(spark):
    """Pairs of similarity 0.75 to 0.80, each of texts of its own: the bands miss next to none."""
    rng, rows, want = random.Random(8), [], 0
    for k in range(150):
        base = [f"{k}x{rng.randrange(10**9)}" for _ in range(rng.randint(60, 160))]
        n = len(base) - 4
        tail = int(n / rng.uniform(0.75, 0.8)) - n  # each new word is a new shingle
        rows += [(2 * k, " ".join(base), "en"), (2 * k + 1, " ".join(base + [f"{k}y{j}" for j in range(tail)]), "en")]
        want += 100 * n >= 75 * (n + tail)
    got = near_duplicates.near_duplicates(documents(spark, rows)).where("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert want == 150 and got >= 149


def test_empty_tables(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert language_id.identify(none).count() == 0
    assert decontamination.find_contamination(none, items).count() == 0
    assert sentencepieces.sample_segmentations(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_pipeline_with_nulls_and_without_rows(spark, tmp_path):
    for name, rows in (("some", [(None, None, None), (3, None, "en"), (4, "", None), (5, "12 34", "en"), (6, "the cat sat on the mat", "en"), (None, "the dog ran", "en"), (8, "the cat and the dog sat", "en")]), ("none", [])):
        documents(spark, rows).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, None), (None, "q r")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert all(r.decodes for r in got) and {r.doc_id for r in got} <= {6, None, 8} and (name == "some") == bool(got)


def test_equal_scores_go_to_the_smaller_label(spark):
    rows = [(k, "abc abd abe", "zz" if k % 2 else "aa") for k in range(40)]
    assert {r.lang_pred for r in language_id.identify(documents(spark, rows)).collect()} == {"aa"}
