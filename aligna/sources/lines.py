"""Plain-text documents as units: a line is a body paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna.functions.text import nonblank


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (from 0, blank lines counted), part, path, source_text, of all lines; null texts have none."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "source_text"))
    return lines.select("doc_id", "pos", F.lit("body").alias("part"), F.concat(F.lit("body/p["), F.col("pos").cast("string"), F.lit("]")).alias("path"), "source_text")


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paragraphs that are not blank; their text stays unstripped."""
    return paragraphs(docs, id_col, text_col).where(nonblank(F.col("source_text")))
