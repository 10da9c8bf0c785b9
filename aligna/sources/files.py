"""Small files: glossary YAML, memory JSON, status JSON, listings, targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligna import constants as K
from aligna import schemas
from aligna.functions.text import size_number

STATUS_MAP = "map<string,struct<status:string,output:string,drive_link:string,units:long,errors:long,warnings:long,cjk_residue:long,tm_hits:long,elapsed_seconds:double,translated_at:string,error:string>>"


def glossary_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all YAML files of a path, in order of file and place; none if there is no such file."""
    import yaml

    rows = []
    try:
        files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("f")).orderBy("f").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = []
    for f in files:
        for t in (yaml.safe_load(f.value) or {}).get("terms") or []:
            rows.append((len(rows), t["source"], t["target"], t.get("domain"), None, bool(t.get("case_sensitive", False)), t.get("note"), True))
    return spark.createDataFrame(rows, schemas.GLOSSARY)


def memory_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all memory files of a path (JSON lists), numbered by file and place; broken files give none."""
    item = "array<struct<source_text:string,target_text:string,source_doc:string,confirmed:boolean,hit_count:long>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.from_json("value", item).alias("x"))
    flat = raw.select("f", F.posexplode("x").alias("i", "e")).where("e.source_text IS NOT NULL AND e.target_text IS NOT NULL")
    files = raw.select("f", F.coalesce(F.size("x"), F.lit(0)).alias("n")).orderBy("f").collect()
    start, total = {}, 0
    for r in files:
        start[r.f], total = total, total + max(0, r.n)
    base = F.create_map(*[F.lit(v) for kv in start.items() for v in kv]) if start else F.create_map()
    return flat.select((base[F.col("f")] + F.col("i")).cast("long").alias("ord"), "e.source_text", "e.target_text", "e.source_doc", F.coalesce("e.confirmed", F.lit(False)).alias("confirmed"), F.coalesce("e.hit_count", F.lit(0)).alias("hit_count"))


def status_json(spark: SparkSession, path: str) -> DataFrame:
    """filename and its record; an absent or broken file gives no rows."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schemas.STATUS)
    return raw.select(F.explode(F.from_json("value", STATUS_MAP)).alias("filename", "r")).select("filename", "r.*")


def tsv_rows(text: str) -> list[dict[str, str]]:
    """A listing: tab-separated with a header, or one record of key-and-value lines.

    Where every line has two fields and there are two lines or more, it is read as one record.
    """
    lines = [x.strip() for x in text.strip().split("\n") if x.strip()]
    fields = [x.split("\t") for x in lines]
    if not fields:
        return []
    if len(fields) > 1 and all(len(f) == 2 for f in fields):
        return [{k.lower(): v for k, v in fields}]
    head = [h.lower() for h in fields[0]]
    return [dict(zip(head, [*f, *[""] * len(head)][: len(head)], strict=True)) for f in fields[1:]]


def listing(spark: SparkSession, text: str) -> DataFrame:
    """list_ord, id, name, size, mime_type of a listing, without the status file."""
    rows = [(i, r.get("id", ""), r.get("name", ""), r.get("size", "-"), r.get("type", "")) for i, r in enumerate(tsv_rows(text))]
    df = spark.createDataFrame(rows, "list_ord long, id string, name string, size string, mime_type string")
    return df.where(F.col("name") != K.STATUS_FILE).withColumn("size", size_number(F.col("size")))


def resolve_targets(source: str, patterns: list[str], folder: str) -> list[str]:
    """Sorted distinct paths: patterns with * ? [ are globbed, others stand for themselves; default: translations of source."""
    from glob import glob
    from pathlib import Path

    wanted = patterns or [str(Path(folder) / f"{Path(source).stem}.en*.docx")]
    return sorted({p for w in wanted for p in (glob(w) if any(c in w for c in "*?[") else [w])})
