"""Translating documents: extract, look up, translate, check, write, report; resumable by unit."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligna import constants as K
from aligna.operators import memory as tm
from aligna.operators import qa, translate, units
from aligna.sources import docx as source
from aligna.sinks import docx as sink
from aligna.sinks import reports


def extract(paragraphs: DataFrame) -> DataFrame:
    """Numbered, non-blank units with their neighbours, from parsed paragraphs; doc_id is the file."""
    u = paragraphs.where("error IS NULL AND part IS NOT NULL").drop("error").withColumnRenamed("file", "doc_id")
    u = u.where(F.length(F.regexp_replace("source_text", r"(?U)^\s+|\s+$", "")) > 0)
    return units.with_context(units.number(u))


def resume(all_units: DataFrame, committed: DataFrame | None) -> DataFrame:
    """Units that are not yet committed; what failed counts as not committed."""
    if committed is None:
        return all_units
    done = committed.where(units.translated(F.col("translated_text"), F.col("error"))).select("doc_id", "unit_id")
    return all_units.join(done, ["doc_id", "unit_id"], "left_anti")


def translate_units(todo: DataFrame, memory: DataFrame, translator: translate.Translator, threshold: float = K.SIMILARITY, spacing: float = 0.0) -> DataFrame:
    """Exact matches first, then similar ones, then one call for each distinct text that is left."""
    first = tm.exact(todo, memory)
    rest = first.where("NOT tm_hit").drop("tm_hit", "tm_target", "tm_ord")
    rest = rest.withColumn("_key", F.concat_ws("\u0001", "doc_id", "unit_id"))
    near = tm.fuzzy(rest, memory, "_key", threshold)
    both = rest.join(near, "_key", "left")
    hit = both.where("tm_ord IS NOT NULL").select(*todo.columns, F.col("tm_target").alias("translated_text"), F.lit(True).alias("tm_hit"), F.lit("difflib_ratio").alias("tm_match_type"), F.round("similarity", 3).alias("tm_similarity"), F.lit(None).cast("string").alias("error"))
    called = translate.distinct_call(both.where("tm_ord IS NULL").select(*todo.columns), translator, spacing=spacing)
    none = called.select(*todo.columns, "translated_text", F.lit(False).alias("tm_hit"), F.lit(None).cast("string").alias("tm_match_type"), F.lit(None).cast("double").alias("tm_similarity"), "error")
    same = first.where("tm_hit").select(*todo.columns, F.col("tm_target").alias("translated_text"), F.lit(True).alias("tm_hit"), F.lit("exact").alias("tm_match_type"), F.lit(1.0).alias("tm_similarity"), F.lit(None).cast("string").alias("error"))
    return same.unionByName(hit).unionByName(none)


def run(spark: SparkSession, path: str, out: str, memory: DataFrame, translator: translate.Translator, glossary: DataFrame | None = None, qa_enabled: bool = True) -> dict:
    """All .docx files under path to <out>/docs, <out>/units (the checkpoint) and <out>/report.md; returns counts.

    A second run takes finished units from <out>/units and does only the rest; failed units are done again.
    """
    paragraphs = source.read_docx(spark, path)
    todo = extract(paragraphs)
    try:
        committed = spark.read.parquet(f"{out}/units")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        committed = None
    fresh = translate_units(resume(todo, committed), memory, translator)
    fresh.write.mode("append").parquet(f"{out}/units")
    committed = spark.read.parquet(f"{out}/units")
    best = committed.groupBy("doc_id", "unit_id").agg(F.max_by(F.struct(*committed.columns), units.translated(F.col("translated_text"), F.col("error")).cast("int")).alias("u")).select("u.*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rendered = sink.render(files, best.withColumnRenamed("doc_id", "file"))
    sink.save(rendered, f"{out}/docs")
    counts = {"Total Units": best.count(), "Translated": qa.done(best).count(), "Memory matches": best.where("tm_hit").count()}
    issues: list[dict] = []
    if qa_enabled:
        s = units.source_stats(best).withColumn("tables", F.lit(None).cast("long"))
        t = units.target_stats(best)
        found = qa.run_all(best, s, t, ["doc_id"], glossary)
        again = source.parse_files(rendered.select(F.col("file").alias("path"), "content"))
        found = found.unionByName(qa.output_residue(again.where("error IS NULL").withColumnRenamed("file", "doc_id"), ["doc_id"])).unionByName(source.unreadable(again).withColumnRenamed("file", "doc_id"))
        issues = [r.asDict() for r in found.orderBy("doc_id", "unit_id", "category", "detail").toLocalIterator()]
        counts |= {"Errors (QA)": sum(i["severity"] == "error" for i in issues), "Warnings (QA)": sum(i["severity"] == "warning" for i in issues)}
    samples = [r.asDict() for r in qa.done(best).orderBy("doc_id", "seq").limit(10).collect()]
    task = {"file": path, "task_id": uuid.uuid4().hex[:12], "status": "completed", "generated": datetime.now(timezone.utc).isoformat()}
    return {"counts": counts, "report": reports.qa_report(task, counts, issues, samples), "issues": issues, **task}
