"""The queries as registered: columns, digests, and accuracy on rows that their models haven't seen."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from aligna.llm import queries

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def area(label, score):
    """Chance that a row labelled 1 scores above one labelled 0, ties counting half."""
    label, score = np.array(label), np.array(score)
    one, none = score[label == 1], score[label == 0]
    return ((one[:, None] > none).mean() + (one[:, None] >= none).mean()) / 2


@pytest.mark.parametrize(
    ("name", "mark", "modulus", "residue", "least"), [("op4_toxicity", "toxic", 4, 2, 0.3), ("op8_quality_classifier", "quality", 3, 1, 0.5)]
)
def test_classifiers_on_rows_held_out(spark, name, mark, modulus, residue, least):
    out = queries.QUERIES[name](spark, LARGE)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == spark.read.parquet(f"{LARGE}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == residue)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    unseen = [(r[mark], rows[r.doc_id]) for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(unseen) >= 500 and {y for y, _ in unseen} == {0, 1}
    assert area([y for y, _ in unseen], [r.score for _, r in unseen]) >= 0.9
    assert np.mean([y == r.predicted for y, r in unseen]) >= 0.9


def test_secrets_digest(spark):
    rule = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op5_secrets(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id]
        found = [(m.start(), 0, m.end()) for m in rule.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
        base = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, x, _ in found) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) if base else True


def test_language_model_columns(spark):
    out = queries.op3_pitman_yor(spark, SMALL)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = out.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
