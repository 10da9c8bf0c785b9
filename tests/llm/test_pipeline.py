"""The pipeline's stages on a small table with every odd row, against brute force."""

import collections
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import test_operators as brute

import corpus_pipeline as pipeline

SF = brute.SF


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None if i is None else 10_000 + i, t, None, None, None) for i, t in brute.ODD], real.schema)
    return real.unionByName(odd).withColumn("score", F.lit("clash")).withColumn("n_hit", F.lit(None).cast("int"))


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        none = stage(spark, docs.where("false"), SF)
        assert none.columns == docs.columns and none.collect() == []
    kept = [spark.read.parquet(str(tmp_path / str(k))) for k in range(4)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic == 0}
    assert toxic <= {r.doc_id for r in kept[0].collect()}
    want = sorted({(i if i is not None else -1) for i, _, c in brute.near(rows, 5, 80) if i == c})
    assert sorted({(-1 if r.doc_id is None else r.doc_id) for r in kept[1].collect()}) == want
    assert kept[1].where("doc_id is not null").count() == kept[1].select("doc_id").where("doc_id is not null").distinct().count()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = brute.contamination(rows, bench)
    assert collections.Counter(r.doc_id for r in kept[2].collect()) == collections.Counter({i: n for i, n in collections.Counter(x[0] for x in clean.elements() if x[2] == 0).items()})
    assert kept[3].count() == docs.count() and not [r for r in kept[3].collect() if brute.spans(r.text)]
    pieces = pipeline.pack(spark, docs, SF)
    assert {r.doc_id for r in pieces.collect()} == {i for i, _ in rows}


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.select("doc_id").distinct().count() <= 200 and out.count() > 0


def test_rows_of_one_id_stay_unless_their_own_text_is_a_copy(spark, docs):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, other), (2, long + " end"), (2, "nothing like it at all here"), (-3, other), (7, "x"), (7, "x"), (8, None), (8, None), (None, long), (None, long)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = collections.Counter((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, df, SF).collect())
    assert got == collections.Counter([(1, long), (2, "nothing like it at all here"), (-3, other), (7, "x"), (8, None), (None, long), (None, long)])


def test_near_duplicates_take_text_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [("b", long), ("a", long + " end"), ("c", "else " * 9), (None, long), ("d", None)]
    got = {r.name: (r.component_id, r.kept) for r in brute.neardup.near_duplicates(spark.createDataFrame(rows, "name string, text string"), id_col="name").collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: (None, True), "d": ("d", True)}
