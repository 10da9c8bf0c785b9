"""The operators' queries, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligna.llm import decontam, gbdt, neardup, packing, pylm, rules, secrets, tokencount, toxicity, warc
from aligna.llm.common import rest, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pylm.score(_table(spark, sf_dir, "documents"), rest(residue=1, modulus=5))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~rest(residue=2, modulus=4))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", rest(residue=2, modulus=4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", lambda x: x["ord"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *counts, F.sha2(secrets.joined("base"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).withColumnRenamed("id", "page_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = rules.train(docs, labels, ~rest(residue=1, modulus=3))
    out = rules.score(docs, model)
    return out.select("doc_id", rest(residue=1, modulus=3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return gbdt.apply_rules(docs, gbdt.train(docs, _table(spark, sf_dir, "labels"))).drop("score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_counts, op3_pitman_yor, op4_toxicity, op5_secrets, op6_warc, op7_decontamination, op8_quality_classifier, op9_quality_rules, op10_near_duplicates)}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
b AS (SELECT page_id, n, list_aggregate([translate(lpad(to_base(CAST('0x' || substr(s, 5 * k + 1, 5) AS BIGINT), 32), 4, '0'),
  '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') FOR k IN range(8)], 'string_agg', '') AS g FROM d),
m AS (SELECT *, min(page_id) OVER (PARTITION BY g, n) AS head FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM m""",
    "op7_decontamination": f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark),
g AS (SELECT item_id, least(10, len(w)) AS k, unnest([array_to_string(w[i:i + least(10, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(10, len(w)) + 2)]) AS s FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM g),
dg AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS s FROM dw, sizes WHERE len(w) >= k),
hits AS (SELECT DISTINCT doc_id, i, g.k, item_id FROM dg JOIN g ON dg.k = g.k AND dg.s = g.s),
hw AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id""",
}
