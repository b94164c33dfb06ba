"""The operators' registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwalk.llm import binary_output, decontamination, language_id, license_scan, near_duplicates, pii, sentencepieces, token_counts, topk_search, url_filter
from driftwalk.llm.common import staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _register(f):
    QUERIES[f.__name__] = f
    return f


@_register
def op1_personal_data(spark, sf_dir):
    return pii.report(pii.find_personal_data(_read(spark, sf_dir, "documents"), ["doc_id"]))


@_register
def op2_sentencepieces(spark, sf_dir):
    return sentencepieces.sample_segmentations(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), with_text=True)


@_register
def op3_url_filter(spark, sf_dir):
    return url_filter.judge(_read(spark, sf_dir, "pages"))


@_register
def op4_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(_read(spark, sf_dir, "documents"))


@_register
def op5_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


@_register
def op6_topk_search(spark, sf_dir):
    return topk_search.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_register
def op7_license_scan(spark, sf_dir):
    return license_scan.scan(_read(spark, sf_dir, "documents"))


@_register
def op8_language_id(spark, sf_dir):
    return language_id.identify(_read(spark, sf_dir, "documents"))


@_register
def op9_decontamination(spark, sf_dir):
    return decontamination.contamination_report(decontamination.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


@_register
def op10_binary_output(spark, sf_dir):
    at = staging(spark, "token-ids")
    binary_output.write_ids(_read(spark, sf_dir, "documents"), at, _tokenizer("byte_bpe_50k.json"))
    return binary_output.read_documents(spark, at)


_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op4_near_duplicates"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_AZ}, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.v WHERE r.low < e.y),
g AS (SELECT v, min(low) low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, g.low component_id, d.doc_id = g.low kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN g ON g.v = d.doc_id"""

SQL["op6_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

SQL["op9_decontamination"] = rf"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex({_AZ}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM documents),
bw AS (SELECT item_id, list_filter(string_split_regex({_AZ}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM benchmark),
b AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') win, least(len(ws), 10) n FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i FROM bw WHERE len(ws) > 0)),
d AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM dw, (SELECT DISTINCT n FROM b) WHERE len(ws) >= n)),
h AS (SELECT d.doc_id, d.i, d.n, b.item_id FROM d JOIN b ON b.win = d.win AND b.n = d.n),
pos AS (SELECT doc_id, count(DISTINCT i + k) n_hit FROM (SELECT doc_id, i, unnest(range(n)) k FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT dw.doc_id, coalesce(len(ws), 0)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id"""

SQL["op7_license_scan"] = license_scan.scan_sql()


@_register
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
