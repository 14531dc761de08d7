"""Registered queries of the operators (contract columns) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitchlens.llm import alignment, centroids, exact_dedup, langid, maxent_lm, mixing, page_text, pieces, simhash, substring_dedup, token_counts, topk, toxicity
from pitchlens.llm._common import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


ORACLE["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), size=3, radius=3).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return topk.top_k(v, v.where("vec_id % 100 = 0"), k=10, scale=1024)


ORACLE["op10_topk"] = """
WITH q AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
scored AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id,
                  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.rid <> b.rid AND len(a.v) = len(b.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op8_mixing"] = mixing.sql()


@query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pieces.encode(docs, rate=0.1, seed=7).select(
        "doc_id", F.size("ids").alias("n_pieces"), "ids_sha256",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.octet_length("decoded").alias("decoded_bytes"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), span=50).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


#: Windows as strings, by their digest.
ORACLE["op5_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM win JOIN least_doc USING (h) WHERE m < doc_id),
gone AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
words AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""


@query
def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), max_rows=10_000)


@query
def op3_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), limit=512)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)


ORACLE["op12_centroids"] = centroids.sql()
