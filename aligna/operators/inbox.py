"""Files to do, and the status of those done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aligna import constants as K


def pending(inbox: DataFrame, status: DataFrame) -> DataFrame:
    """Listed .docx files, the status file left out, without a status of success."""
    files = inbox.where((F.col("name") != K.STATUS_FILE) & F.lower("name").endswith(".docx"))
    done = status.where("status = 'success'").select(F.col("filename").alias("name"))
    return files.join(done, "name", "left_anti")


def next_file(inbox: DataFrame, status: DataFrame) -> DataFrame:
    """The first of them in listing order."""
    return pending(inbox, status).orderBy("list_ord").limit(1)


def upsert(status: DataFrame, records: DataFrame) -> DataFrame:
    """status with the rows of records in place of those of the same filename."""
    return status.join(records.select("filename"), "filename", "left_anti").unionByName(records, allowMissingColumns=True)


def conclusion():
    """Column over errors and cjk_residue."""
    return F.when((F.col("errors") == 0) & (F.col("cjk_residue") == 0), F.lit("passed")).when(F.col("errors") == 0, F.concat(F.col("cjk_residue").cast("string"), F.lit(" residues to fix"))).otherwise(F.concat(F.col("errors").cast("string"), F.lit(" errors to review")))


def elapsed():
    """Column: minutes and seconds from 60 s on."""
    s = F.col("elapsed_seconds")
    return F.when(s >= 60, F.concat(F.bround(s / 60, 0).cast("long").cast("string"), F.lit("m"), F.bround(s % 60, 0).cast("long").cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))
