import random

from pyspark.sql import functions as F

from driftwalk.llm import url_filter


def made(n_hosts, seed):
    """URLs of two kinds by their look alone; a tenth of the hosts' URLs have the other look."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for h in range(n_hosts):
        bad = rng.random() < 0.4
        word = lambda n: "".join(rng.choice(letters) for _ in range(n))
        host = f"{word(5)}{rng.randrange(10**6)}.{word(3)}.top" if bad else f"www.{word(9)}.edu"
        for _ in range(6):
            path = f"/{word(3)}{rng.randrange(10**9)}?id={rng.randrange(10**9)}&s={rng.randrange(10**9)}&t=%20" if bad else f"/{word(7)}/{word(6)}.html"
            yield f"http://{host}{path}", "block" if bad else "allow", h


def test_trees_judge_unseen_hosts(spark):
    rows = list(made(300, 1))
    train = [(u, v) for u, v, h in rows if h % 3]
    test = [(k, u, v) for k, (u, v, h) in enumerate(rows) if not h % 3]
    pages = spark.createDataFrame(test, "page_id long, url string, want string")
    labelled = spark.createDataFrame([*train, *train[:50], (None, "block"), ("http://x.y/", None)], "url string, verdict string")
    got = url_filter.judge(pages, rules=(), labelled=labelled).join(pages.select("page_id", "want"), "page_id")
    assert got.count() == len(test)
    assert got.where("verdict = want").count() / len(test) > 0.95


def test_ties_repeats_and_long_urls(spark):
    urls = ["http://a.b.example.net/en/x", "http://a.b.example.net/en/x", None, None, "http://h.zz/" + "p" * 200_000 + "?" + "q=1&" * 20_000, "http://i.net/", "http://o.org/fr/"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert len(got) == len(urls)
    assert got[0].rule == got[1].rule == "example.net/en/" and got[0].verdict == got[1].verdict == "allow"  # the longer rule
    assert (got[2].verdict, got[2].block_score) == (got[3].verdict, got[3].block_score)
    tie = url_filter.judge(spark.createDataFrame([(1, "http://a.bc/de")], "page_id long, url string"), rules=(("bc", "/de", "allow"), ("a.bc", "/", "block"), ("bc", "/d", "block")))
    assert tie.select("rule", "verdict").first() == ("bc/de", "allow")


def test_suffixes_that_rules_name_have_no_statistics(spark):
    counts = url_filter.suffix_counts(spark.createDataFrame([("a.net", "block"), ("x.org", "allow")], "host string, verdict string"))
    assert {r.suffix for r in counts.collect()} == {"net", "a.net", "org", "x.org"}
    rows = url_filter.with_statistics(spark.createDataFrame([("b.net",)], "host string"), counts.where(~F.col("suffix").isin("net")))
    assert rows.first().n_1 == 0
