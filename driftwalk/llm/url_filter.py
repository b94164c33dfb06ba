"""Operator 3: URL filter: host and path rules, and gradient-boosted trees for all other URLs.

The trees learn from labelled URLs, or where none are given from those that a
rule decides: a sample of at most `sample_rows` of them chosen by a hash of the
URL (a documented bound). They see lexical features alone: lengths, depth,
digit ratio, entropy, counts of parameters, and block rates and supports of the
host's last labels, counted over all distinct labelled URLs and joined to the
rows. Suffixes that rules name have no statistics: they would but repeat the rule.

Null URLs and those without `://`: empty host and path, no rule, judged by the
trees like any other. Repeated rows are judged each; of a URL that is labelled
both ways, the block counts. Rules of equal length: the first listed. Without labelled
URLs of both kinds the verdict of URLs without a rule is the one that occurs,
else allow. An empty table gives no rows. Very long URLs are read whole, in
linear time.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwalk.llm.common import staged

# Host suffix and path prefix, and what becomes of such URLs.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Longest: of rule text, then the first."""
    rule = verdict = F.lit(None).cast("string")
    for suffix, prefix, what in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, F.lit(suffix + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


_RUNS = re.compile(r"[0-9]+|[A-Za-z]+")


def lexical(url: str | None) -> list[float]:
    text = (url or "")[:]
    _, _, rest = text.partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    query = rest.partition("?")[2].partition("#")[0]
    counts, n = Counter(text), len(text)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    digits = sum(counts[c] for c in "0123456789")
    runs = [len(x) for x in _RUNS.findall(host)]
    return [
        n, len(host), len(path), len(query), path.count("/"), host.count("."), digits / n if n else 0.0, sum(c.isdigit() for c in host), entropy,
        query.count("=") + query.count("&"), float("#" in rest), counts["-"], counts["%"] + counts["_"], float(text.startswith("https")), max(runs, default=0), float(path.endswith("/")),
    ]


def suffix_columns(host: Column) -> tuple[Column, Column]:
    """The last label and the last two labels of the host."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, n, blocked): how many of labelled(host, verdict) end so, and how many of them are blocked."""
    each = labelled.select(F.explode(F.array_distinct(F.array(*suffix_columns(F.col("host"))))).alias("suffix"), (F.col("verdict") == "block").cast("long").alias("blocked"))
    return each.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))


STATISTICS = ("n_1", "blocked_1", "n_2", "blocked_2")


def with_statistics(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """rows(host, ...) with the counts of both suffixes, 0 for those without labelled URLs."""
    for k, suffix in enumerate(suffix_columns(F.col("host")), 1):
        known = counts.select(F.col("suffix").alias(f"suffix_{k}"), F.col("n").alias(f"n_{k}"), F.col("blocked").alias(f"blocked_{k}"))
        rows = rows.withColumn(f"suffix_{k}", suffix).join(known, f"suffix_{k}", "left").drop(f"suffix_{k}")
    return rows.fillna(0, list(STATISTICS))


class BoostedTrees:
    """Logistic gradient boosting over quantile bins; trees of fixed depth, grown level by level."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned, mean = self._binned(x), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = math.log(mean / (1 - mean))
        margin = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            feature, cut, value = self._grow(binned, y - p, p * (1 - p))
            self.forest.append((feature, cut, value))
            margin += value[self._leaf(binned, feature, cut)]
        return self

    def _grow(self, binned, gradient, hessian):
        feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 1 << 30)
        node = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f in range(binned.shape[1]):
                size = len(self.edges[f]) + 1
                key = (node - first) * size + binned[:, f]
                g = np.bincount(key, gradient, width * size).reshape(width, size).cumsum(axis=1)
                h = np.bincount(key, hessian, width * size).reshape(width, size).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - total_g**2 / (total_h + self.ridge)
                top = gain[:, :-1].argmax(axis=1) if size > 1 else np.zeros(width, np.int64)
                value = gain[np.arange(width), top] if size > 1 else np.zeros(width)
                better = value > best
                best = np.where(better, value, best)
                feature[first : first + width][better], cut[first : first + width][better] = f, top[better]
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        leaf = node - (2**self.depth - 1)
        g, h = (np.bincount(leaf, v, 2**self.depth) for v in (gradient, hessian))
        return feature, cut, self.rate * g / (h + self.ridge)

    def _leaf(self, binned, feature, cut):
        node = np.zeros(len(binned), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        return node - (2**self.depth - 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        binned, margin = self._binned(x), np.full(len(x), self.base)
        for feature, cut, value in self.forest:
            margin += value[self._leaf(binned, feature, cut)]
        return 1 / (1 + np.exp(-margin))


class UrlModel:
    """Trees fitted to a sample of (url, verdict, STATISTICS); n and blocked count all labelled URLs."""

    def __init__(self, sample: list, n: int, blocked: int, smooth: float = 20.0):
        self.rate, self.smooth = blocked / n if n else 0.5, smooth
        self.constant = None if 0 < blocked < n else (1.0 if n and blocked == n else 0.0)
        if self.constant is None:
            x = self.features([r.url for r in sample], [[r[c] for r in sample] for c in STATISTICS])
            self.trees = BoostedTrees().fit(x, np.array([r.verdict == "block" for r in sample], np.float64))

    def features(self, urls: list[str | None], statistics: list[list[int]]) -> np.ndarray:
        """Lexical features, and smoothed block rate and support of both host suffixes."""
        rows = []
        for url, n_1, blocked_1, n_2, blocked_2 in zip(urls, *statistics, strict=True):
            row = lexical(url)
            for n, b in ((n_1, blocked_1), (n_2, blocked_2)):
                row += [(b + self.smooth * self.rate) / (n + self.smooth), math.log1p(n)]
            rows.append(row)
        return np.array(rows, np.float64).reshape(len(urls), -1)

    def probability(self, urls: list[str | None], statistics: list[list[int]]) -> np.ndarray:
        """Of being blocked."""
        if not len(urls) or self.constant is not None:
            return np.full(len(urls), self.constant if self.constant is not None else 0.0)
        return self.trees.probability(self.features(urls, statistics))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample_rows: int = 20_000, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score); block_score is null where a rule decides.

    labelled(url, verdict): URLs to learn from, verdict allow or block.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    decided = ruled.where("verdict IS NOT NULL")
    if labelled is None:
        known = decided.select("url", "host", "verdict")
    else:
        known = labelled.select(F.col("url").cast("string").alias("url"), "verdict").where("url IS NOT NULL AND verdict IS NOT NULL").select("url", host.alias("host"), "verdict")
    distinct = known.groupBy("url").agg(F.first("host").alias("host"), F.max("verdict").alias("verdict"))  # block, if both occur
    named = [suffix for suffix, _, _ in rules]
    counts = staged(suffix_counts(distinct).where(~F.col("suffix").isin(named)) if named else suffix_counts(distinct), "url-suffixes")
    total = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("verdict") == "block").cast("long")), F.lit(0)).alias("blocked")).first()
    sample = with_statistics(distinct.select(F.xxhash64("url").alias("h"), "url", "host", "verdict").orderBy("h", "url").limit(sample_rows), counts).orderBy("h", "url").collect()
    held = pages.sparkSession.sparkContext.broadcast(UrlModel(sample, total.n, total.blocked))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("block_score", pa.float64())])

    def decide(batches):
        for batch in batches:
            scores = held.value.probability(batch.column("url").to_pylist(), [batch.column(c).to_pylist() for c in STATISTICS])
            verdicts = ["block" if p >= threshold else "allow" for p in scores.tolist()]
            columns = [batch.column("page_id"), batch.column("host"), batch.column("path"), batch.column("rule"), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    judged = with_statistics(ruled.where("verdict IS NULL"), counts).mapInArrow(decide, "page_id long, host string, path string, rule string, verdict string, block_score double")
    return decided.select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("block_score")).unionByName(judged)
