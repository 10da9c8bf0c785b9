"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent on one machine (tests) a temporary folder takes its place; a cluster without it
    is an error, as executors would write where nobody else reads.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="aligna-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path, schema = scratch(df.sparkSession, name), df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def side(small: DataFrame, most: int = 100_000) -> DataFrame:
    """The smaller side of a join, settled before: broadcast up to `most` rows, else merged."""
    return F.broadcast(small) if small.count() <= most else small.hint("merge")


@contextlib.contextmanager
def heavy_rows(spark: SparkSession, most: int = 4):
    """For queries run within over rows of many MB: few of them at once go to Python, and shuffle files end with the query."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(most), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop(settled: DataFrame) -> None:
    """Delete the files of a table that settle has written and no later query reads."""
    spark = settled.sparkSession
    for folder in {f.rpartition("/")[0] for f in settled.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What a Python worker keeps from task to task, by operator, and how to drop it.
KEPT: dict[str, object] = {}


def begin(keep: str = "") -> None:
    """At the start of a task: give back what other operators' tasks have left in this worker."""
    for name in [k for k in KEPT if k != keep]:
        del KEPT[name]
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the machine: workers live on from task to task, beside each other."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def rest(id_col: str = "doc_id", residue: int = 0, modulus: int = 1):
    """Column: crc32 of the id as text leaves this residue; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % modulus == residue


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser over uint64 arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def numbered(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts end to end, the bounds of each text, and the distinct words.

    Words are runs without ASCII white space; lower: with A-Z lowered.
    """
    column = pa.array(texts, pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    every = split.flatten().dictionary_encode()
    flat, bounds, words = every.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64), [w.encode() for w in every.dictionary.to_pylist()]
    if b"" in words:  # what white space at an end of a text leaves
        gap = words.index(b"")
        kept = flat != gap
        bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        flat, words = flat[kept], words[:gap] + words[gap + 1 :]
        flat -= flat > gap
    return flat, bounds, words


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def slices(docs: list[bytes], most: int = 1 << 20):
    """Bounds of runs of documents of about that many bytes, so that numpy work on a run stays small."""
    start, size = 0, 0
    for i, d in enumerate(docs):
        size += len(d)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(docs):
        yield start, len(docs)


def carried(docs: DataFrame, text_col: str, compute, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """docs with all its columns and new ones that compute(texts) gives as arrays, map-only.

    fields: (name, Spark type, Arrow type). A column of docs by a new one's name is replaced.
    """
    from pyspark.sql import types as T

    names = [f"c{i}" for i in range(len(docs.columns))]
    kinds = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)])
    for i, (_, kind, _) in enumerate(fields):
        kinds = kinds.add(f"n{i}", T.StructType.fromDDL(f"x {kind}")[0].dataType)
    place = docs.columns.index(text_col)

    def run(batches):
        begin()
        for batch in batches:
            texts = raw(batch.column(place))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                new = [pa.array(x, f[2]) for x, f in zip(compute(texts[a:b]), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *(f"n{i}" for i in range(len(fields)))])

    out = docs.toDF(*names).mapInArrow(run, kinds)
    fresh = [f[0] for f in fields]
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in fresh], *[F.col(f"n{i}").alias(c) for i, c in enumerate(fresh)])
