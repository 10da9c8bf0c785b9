"""WARC archives of pages, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import base64
import hashlib
from urllib.parse import unquote_plus

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from aligna.llm.common import settle, side

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
M = len(MAGIC)


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the text's UTF-8: eight times 20 bits are four digits each."""
    h = F.sha1(text)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: Bits of the map of repeated digests: 8 MB, whatever the number of pages.
BITS = 26


def repeated(digests: DataFrame):
    """A column function: may this digest be one of these? Never a wrong no; some wrong yes as the map fills."""
    place = F.shiftrightunsigned(F.xxhash64("digest"), 64 - BITS)
    words = digests.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most 2**20 rows
    bits = np.zeros(1 << BITS - 6, np.uint64)
    bits[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    sent = digests.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64).view(np.uint64)
        return pd.Series((sent.value[x >> np.uint64(6)] >> (x & np.uint64(63)) & np.uint64(1)).astype(bool))

    return lambda digest: held(F.shiftrightunsigned(F.xxhash64(digest), 64 - BITS))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", most_records: int = 20000) -> None:
    """One record for each row, in text files under path, each a valid archive of at most most_records records.

    Of records with equal payloads (by SHA-1 and length) of at least least_bytes, that with the least id is a response,
    the others revisits without the payload that name it. Null payloads are empty. Rows whose id is null are
    responses, and repeated rows of a group's least id are responses too. Ids may be of any type that orders; they are
    written percent-encoded. Line ends in URLs are dropped. Payloads that occur once are written by the task that
    reads them: only digests are shuffled to find the repeated ones, whose map of a fixed size is broadcast, and
    only rows that it may hold go through the join, whose skew Spark may split.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\r\n]", "").alias("url"), payload.alias("payload"))
    rows = rows.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    heads = rows.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("id").alias("head"), F.count("*").alias("times")).where("times > 1 AND head IS NOT NULL").drop("times")
    heads = settle(heads, "heads")
    maybe = rows.withColumn("maybe", repeated(heads)("digest"))
    once = maybe.where("NOT maybe").withColumn("head", F.lit(None).cast(pages.schema[id_col].dataType)).drop("maybe")
    rows = once.unionByName(maybe.where("maybe").drop("maybe").join(heads.hint("merge"), ["digest", "n"], "left"))
    revisit = F.coalesce(F.col("id") != F.col("head"), F.lit(False))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))

    def urn(key):
        return F.concat(F.lit("<urn:page:"), F.url_encode(F.col(key).cast("string")), F.lit(">"))

    lines = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), F.coalesce(urn("id"), F.lit("<urn:none>")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), "url",
        F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest", F.lit("\r\nWARC-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn("head"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )
    rows.select(lines.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", most_records).text(path)


def _header(segment: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Length up to the payload, and the fields; None if this can't be a record."""
    end = segment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(line.split(b": ", 1) for line in segment[:end].split(b"\r\n") if b": " in line)
    return (end + 4, fields) if fields.get(b"Content-Length", b"").isdigit() else None


def _page(field: bytes | None) -> str | None:
    value = (field or b"").removesuffix(b">")
    return unquote_plus(value.removeprefix(b"<urn:page:").decode(errors="replace")) if value.startswith(b"<urn:page:") else None


SCAN = "path string, block long, total long, at long, length long, next long, exit long, tin long, tout long, complete boolean, type string, id string, refers string, digest string, bytes long"


def _scan(batches):
    """A row for each stretch between magics: where it is in its block, its successor, and the first place its chain
    reaches outside the block. Only slim rows leave; payloads are digested here.

    tin and tout number the block's trees (a stretch's parent is its successor there), so that a stretch is on the
    chain of another one if and only if its tin..tout holds the other's tin.
    """

    def rows(path, block, segments, total):
        at_index = {s["at"]: s for s in segments}
        for s in segments:  # successors come later, so that a stretch has its size before it adds to its parent's
            s["size"] = s.get("size", 0) + 1
            if (up := at_index.get(s["next"])) is not None:
                up["size"] = up.get("size", 0) + s["size"]
        free = 0
        for s in reversed(segments):
            n, up = s["next"], at_index.get(s["next"])
            inside = n is not None and n < total - M
            s["exit"] = n if not inside else up["exit"] if up else None
            s["total"] = total
            if up is None:
                s["tin"], free = free, free + s["size"]
            else:
                s["tin"], up["free"] = up["free"], up["free"] + s["size"]
            s["free"], s["tout"] = s["tin"] + 1, s["tin"] + s["size"]
        return pa.RecordBatch.from_pylist(segments, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCAN.split(", ")])
    now, segments, total = None, [], 0
    for batch in batches:
        for value, path, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (path, block) != now:
                if now:
                    yield rows(*now, segments, total)
                now, segments, total = (path, block), [], 0
            s = {"path": path, "block": block, "at": total - M, "length": len(value), "next": None, "exit": None, "complete": None, "type": None, "id": None, "refers": None, "digest": None, "bytes": None}
            found = _header(value) if block or total else None
            if found:
                start, fields = found
                size = int(fields[b"Content-Length"])
                body = value[start : start + size]
                revisit = fields.get(b"WARC-Type") == b"revisit"
                s["next"] = total + start + size + len(END)
                s["complete"] = revisit or len(body) == size
                s["type"], s["id"] = fields.get(b"WARC-Type", b"").decode(errors="replace"), _page(fields.get(b"WARC-Record-ID"))
                if revisit:
                    s["refers"], s["digest"] = _page(fields.get(b"WARC-Refers-To")), fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode(errors="replace")
                    s["bytes"] = int(x) if (x := fields.get(b"WARC-Payload-Length", b"")).isdigit() else None
                elif s["complete"]:
                    s["digest"], s["bytes"] = base64.b32encode(hashlib.sha1(body).digest()).decode(), size
                else:
                    s["bytes"] = size
            segments.append(s)
            total += len(value) + M
    if now:
        yield rows(*now, segments, total)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives under path.

    Tasks read blocks of files and give, for every place where the magic stands, the place of its successor
    (header, Content-Length and end mark added up). What blocks hold before is summed to turn places in a block into
    places in the file. From each file's start, pointers are followed by jumping: chains are shortened to their
    exit within a block, then doubled between blocks, so that a file of b blocks takes log2(b) rounds; only places at
    which some chain enters a block take part, so that the rounds' tables grow with the blocks, not the records. Only
    records so reached are kept; a magic inside a payload is not. Payloads that hold one are put together in a
    second reading. Ids come back as text cast to id_type; archives without a record give no rows.
    """
    seg = settle(_segments(spark, path).mapInArrow(_scan, SCAN), "segments")
    blocks = seg.groupBy("path", "block").agg(F.max("total").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = settle(blocks.select("path", "block", before.alias("base")), "bases")
    moved = {c: F.col(c) + F.col("base") for c in ("at", "next", "exit")}
    placed = seg.withColumn("local", F.col("at")).join(side(base), ["path", "block"]).withColumns(moved).drop("base", "total")
    starts = placed.where("exit IS NOT NULL").select("path", F.col("exit").alias("at")).distinct()
    starts = settle(starts, "starts")
    first = placed.where("next IS NOT NULL").select("path", "at", F.col("exit").alias("to"), "block", "tin")
    jump = settle(first.where("at = 0").unionByName(first.where("at <> 0").join(side(starts), ["path", "at"], "left_semi")), "jumps")
    reached, n = settle(jump.where("at = 0").select("path", "at"), "reached"), 0
    step = jump.select("path", "at", "to").join(side(jump.select("path", F.col("at").alias("to"))), ["path", "to"], "left_semi")
    while (now := reached.count()) > n:
        n = now
        more = reached.join(side(step), ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = settle(reached.unionByName(more).distinct(), "reached")
        further = step.select("path", F.col("at").alias("to"), F.col("to").alias("further"))
        step = settle(step.join(side(further), ["path", "to"]).select("path", "at", F.col("further").alias("to")), "jumps")
    entries = settle(jump.join(side(reached), ["path", "at"], "left_semi").select("path", "block", F.col("tin").alias("entry")), "entries")
    real = placed.join(side(entries), ["path", "block"]).where("next IS NOT NULL AND tin <= entry AND entry < tout")
    records = real.select("path", "block", "at", "local", "complete", "type", "id", "refers", "digest", "bytes")
    whole = records.where("complete")
    if records.where("NOT complete").isEmpty():
        return _result(whole, id_type)
    # stretches that belong to a record whose payload holds the magic
    owner = F.last("rec", ignorenulls=True).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    tied = placed.select("path", "block", "at", "local").join(records.select("path", "at", F.struct("at", "complete", "bytes").alias("rec")), ["path", "at"], "left")
    tied = tied.select("path", "block", "at", "local", owner.alias("rec")).where("NOT rec.complete")
    tied = settle(tied.select("path", "block", "local", "at", F.col("rec.at").alias("record")), "tied")

    def stretches(batches):
        now, total = None, 0
        for batch in batches:
            local = []
            for value, p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (p, block) != now:
                    now, total = (p, block), 0
                local.append(total - M)
                total += len(value) + M
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(local, pa.int64()), batch.column(0)], names=["path", "block", "local", "value"])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        data = MAGIC.encode().join(bytes(v) for v in pdf["value"])
        start, fields = _header(data)
        body = data[start : start + int(fields[b"Content-Length"])]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "at": [int(pdf["record"].iloc[0])], "digest": [base64.b32encode(hashlib.sha1(body).digest()).decode()], "bytes": [len(body)]})

    parts = _segments(spark, path).mapInArrow(stretches, "path string, block long, local long, value binary").join(tied, ["path", "block", "local"])
    found = parts.groupBy("path", "record").applyInPandas(together, "path string, at long, digest string, bytes long")
    more = records.where("NOT complete").drop("digest", "bytes").join(found, ["path", "at"])
    return _result(whole.unionByName(more), id_type)


def _result(records: DataFrame, id_type: str) -> DataFrame:
    return records.select(F.col("id").cast(id_type).alias("id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast(id_type).alias("refers_to"))
