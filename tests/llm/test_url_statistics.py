import collections
import math

from driftwalk.llm import url_filter


def test_suffix_statistics_cover_all_labelled_urls(spark, monkeypatch):
    urls = [f"http://h{k}.{'example.net/en' if k % 2 else 'rare%d.net' % (k % 6)}/{k}" for k in range(200)] + ["http://a.rare2.net/de/", "http://un.ruled.com/x", None]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    seen = []

    def fit(self, x, y, fit=url_filter.BoostedTrees.fit):
        seen.append(x)
        return fit(self, x, y)

    monkeypatch.setattr(url_filter.BoostedTrees, "fit", fit)
    got = url_filter.judge(df, sample_rows=12).collect()
    assert sorted(r.page_id for r in got) == list(range(len(urls)))
    assert {r.page_id for r in got if r.block_score is not None} == {201, 202}
    two = collections.Counter(".".join(u.split("/")[2].split(".")[-2:]) for u in urls[:201])
    assert len(seen[0]) == 12
    assert {round(math.exp(v)) - 1 for v in seen[0][:, -3]} == {0}  # a rule names net
    assert {round(math.exp(v)) - 1 for v in seen[0][:, -1]} <= {0, *(n for s, n in two.items() if s != "example.net")}
    assert max(seen[0][:, -1]) > math.log1p(12)  # more than the sample holds
