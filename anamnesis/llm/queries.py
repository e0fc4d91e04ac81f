"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm.common import table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.token_shards import token_shards

    return token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.learn(docs.where(~langid.held_out())))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.simhash import linked

    return linked(table(spark, sf_dir, "documents"), words=3)


def op7_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10).drop("hit_words")


#: Fixed rules of the URL query: (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
PII_KEY = "surrogates-1"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.pii import replace

    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, extra=True)


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_text=False)


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anamnesis.llm.nn_descent import neighbours

    return neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from anamnesis.llm.url_rules import judge, mine

    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(((F.min("quality") == 0) | (F.max("toxic") == 1)).alias("bad"))
    rules = mine(pages.select("page_id", "url").join(bad, "page_id").select("url", "bad"))
    return judge(pages, rules, URL_RULES).drop("mined")


QUERIES = {f.__name__: f for f in (op1_token_shards, op2_warc_chunks, op3_pii_surrogates, op4_importance_resampling, op5_language_id, op6_simhash, op7_bpe_stream, op8_nn_descent, op9_decontaminate, op10_url_rules)}

OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""

SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
h AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM di) JOIN bw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE = {"op2_warc_chunks": OP2_SQL, "op9_decontaminate": OP9_SQL}
