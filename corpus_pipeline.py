"""From raw documents to packed training sequences: five stages, each calling one operator.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents. Nulls: a null text is never toxic, duplicated, contaminated or secret and is packed as its end
token alone; a document without an id is kept through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligna.llm import decontam, neardup, packing, secrets, toxicity
from aligna.llm.common import settle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, by a model fitted on those of them that labels mark."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.score(docs, model, name="_score").where("_score < 0.3").drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the least id) of each group linked at 80 % of five-word shingles.

    Where ids are repeated, rows are told apart by id and text: of rows that share both one stays, of rows that share
    the id alone those go whose own text is linked to that of a kept row.
    """
    columns = docs.columns
    more = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if more.isEmpty():
        gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(columns)
    # in the order of the ids, then by text: both numbers as hexadecimal digits, the lowest first
    digits = [F.lpad(F.hex(x.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0") for x in (F.col("doc_id"), F.xxhash64("text"))]
    least = F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")
    keyed = docs.where("doc_id IS NOT NULL").withColumn("_key", F.concat(*digits)).groupBy("_key").agg(least)
    keyed = settle(keyed.select("_key", *[F.col("row").getField(c).alias(c) for c in columns]), "keyed")
    gone = neardup.near_duplicates(keyed, id_col="_key").where("NOT kept").select("_key")
    return keyed.join(gone, "_key", "left_anti").select(columns).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    out = decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return out.where("n_hit = 0").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts become [SECRET], and n_chars follows the text."""
    out = secrets.find_secrets(docs)
    out = out.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        n = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]

#: The stages fit a model, sketch and tokenize, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
