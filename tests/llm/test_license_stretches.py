import random

import duckdb
import pytest

from driftwalk.llm import license_scan


@pytest.fixture(scope="module")
def sql_rows():
    def run(texts, templates):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
        got = con.execute(license_scan.scan_sql(templates))
        names = [d[0] for d in got.description]
        return names, got.fetchall()

    return run


def scanned(spark, texts, names, templates):
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates).collect()
    return [tuple(r[c] for c in names) for r in rows]


def test_all_stretches_equal_sql(spark, sql_rows):
    mit, bsd, short = (dict(license_scan.TEMPLATES)[n] for n in ("MIT-text", "BSD-3-Clause-text", "MIT"))
    words = mit.split()
    texts = [f"{mit} {mit}", f"x {mit} " + "y " * 50 + f"{bsd} z {mit}", " ".join(words[:150] + words), " ".join(words[30:] + words), f"{short} a {short} {short}", " ".join([short] * 40), " ".join(words[::-1])]
    names, want = sql_rows(texts, license_scan.TEMPLATES)
    assert sorted(scanned(spark, texts, names, license_scan.TEMPLATES)) == sorted(want)
    assert sum(r[names.index("doc_id")] == 0 and r[names.index("license")] == "MIT-text" for r in want) == 2


def edited(rng, words, share):
    """Words replaced, dropped and put in, until about `share` of the shingles is left."""
    out = list(words)
    own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    while len(own & {tuple(out[k : k + 5]) for k in range(len(out) - 4)}) > share * len(own):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + 1] = [["new"], [], [out[at], "more"]][kind]
    return out


def test_recall_near_the_threshold(spark, sql_rows):
    """Edited notices that hold 75 to 95 % of a template: what the bands retrieve of what all comparisons find."""
    rng, texts = random.Random(6), []
    for _ in range(12):
        for _, text in license_scan.TEMPLATES:
            texts.append("lead in " * rng.randrange(9) + " ".join(edited(rng, license_scan.template_words(text), rng.uniform(0.75, 0.95))) + " and so on" * rng.randrange(9))
    names, want = sql_rows(texts, license_scan.TEMPLATES)
    got = scanned(spark, texts, names, license_scan.TEMPLATES)
    assert set(got) <= set(want) and len(got) == len(set(got))
    assert len(got) / len(want) > 0.97, (len(got), len(want))


def test_repeated_rows_ties_and_long_texts(spark):
    mit = dict(license_scan.TEMPLATES)["MIT"]
    docs = spark.createDataFrame([(1, mit), (1, mit), (2, "word " * 200_000 + mit), (None, mit)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.license, r.start_word) for r in license_scan.scan(docs).collect())
    assert got == [("1", "MIT", 0), ("1", "MIT", 0), ("2", "MIT", 200_000), ("None", "MIT", 0)]
