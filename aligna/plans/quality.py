"""Scoring candidate translations of a DOCX file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aligna.functions.text import strip
from aligna.operators import score, units
from aligna.sinks import reports
from aligna.sources import docx, files


def evaluate(spark: SparkSession, source: str, targets: list[str], glossary: DataFrame | None = None) -> DataFrame:
    """metrics rows, one for each target; the source is read once."""
    if not Path(source).exists():
        raise FileNotFoundError(source)
    if not targets:
        raise ValueError("no targets")

    def load(paths):
        frame = docx.read_docx(spark, paths)
        return frame.where("error IS NULL").withColumn("pos", F.col("pos").cast("long"))

    src, tgt = load([source]), load(targets).withColumn("name", F.regexp_extract("file", r"([^/]*)$", 1))
    names = tgt.select("name").distinct()
    full = lambda df: df.where(F.length(strip(F.col("source_text"))) > 0)
    s = units.path_map(full(src), (), order="pos").crossJoin(F.broadcast(names))
    t = units.path_map(full(tgt), ("name",), order="pos").withColumnRenamed("source_text", "target_text")
    counts = score.pair_counts(score.unit_measures(score.align(s, t, ["name"]), glossary=glossary), ["name"])
    raw = units.structure(src, ()).crossJoin(F.broadcast(names))
    return score.metrics(score.with_structure(counts, raw, units.structure(tgt, ("name",)), ["name"], ["name"]))


def report(spark: SparkSession, source: str, patterns: list[str], folder: str, glossary: DataFrame | None = None, exclude: list[str] = ()) -> tuple[str, list[dict]]:
    """The text dashboard and its rows, best first."""
    found = evaluate(spark, source, files.resolve_targets(source, patterns, folder), glossary)
    rows = [r.asDict() for r in score.rank(found, [], exclude=list(exclude)).orderBy("rank").collect()]
    return reports.dashboard(source, rows), rows
