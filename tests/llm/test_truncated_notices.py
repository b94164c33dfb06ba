import duckdb

from driftwalk.llm import license_scan


def test_truncated_notices_equal_sql(spark):
    texts = []
    for _, text in license_scan.TEMPLATES:
        words = license_scan.template_words(text)
        texts += [" ".join(words[:n]) for n in range(5, len(words) + 1)]
        texts += ["lead in words " * 9 + " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = con.execute(license_scan.scan_sql())
    names = [d[0] for d in got.description]
    want = sorted(got.fetchall())
    assert want == sorted(tuple(r[c] for c in names) for r in license_scan.scan(docs).collect())
